"""Folders of uploads: dialects, headers, odd files, roles and flags."""
import pytest

from cohortlens.sources import upload_folder as U

FILES = {
    "a.csv": "id,name,note\n1,Ann,\"x, y\"\n2,Bo,\n",
    "b.csv": "﻿id;name;note\n3;Cy;\"say \"\"hi\"\"; you\"\n",
    "sub/c.csv": "name|grade|grade\nDi|4|5\n",
    "d.csv": "id,name,note\n4,Ed\n",
    "header.csv": "id\textra\n",
    "empty.csv": "",
}


@pytest.fixture()
def folder(tmp_path):
    for name, text in FILES.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(tmp_path / "in")


def test_files_of_several_dialects_are_one_table(spark, folder):
    t = U.read_folder(spark, folder)
    assert sorted(t.columns[:-1]) == ["extra", "grade", "grade_1", "id", "name", "note"] and t.columns[-1] == "upload_file"
    got = sorted((r["name"], r["id"], r["note"], r["grade"], r["grade_1"], r["extra"], r["upload_file"].rsplit("/", 1)[1]) for r in t.collect())
    assert got == [("Ann", "1", "x, y", None, None, None, "a.csv"), ("Bo", "2", None, None, None, None, "a.csv"),
                   ("Cy", "3", 'say "hi"; you', None, None, None, "b.csv"), ("Di", None, None, "4", "5", None, "c.csv"),
                   ("Ed", "4", None, None, None, None, "d.csv")]


def test_dialect_of_every_file_with_a_line(spark, folder):
    got = {r["file"].rsplit("/", 1)[1]: (r["sep"], r["header"]) for r in U.dialects(spark, folder).collect()}
    assert got == {"a.csv": (",", "id,name,note"), "b.csv": (";", "id;name;note"), "c.csv": ("|", "name|grade|grade"),
                   "d.csv": (",", "id,name,note"), "header.csv": ("\t", "id\textra")}


def test_clashing_name_and_empty_folder(spark, folder, tmp_path):
    with pytest.raises(ValueError):
        U.read_folder(spark, folder, file_col="note")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    assert U.read_folder(spark, str(tmp_path / "none")).columns == []


def test_roles_types_and_flags(spark, folder):
    t = U.read_folder(spark, folder, file_col=None)
    got = {r["column_name"]: r for r in U.upload_overview(t, {"key": ["id"], "result": ["grade", "grade 1"], "who": ["name"]}).collect()}
    assert {c: (r["role"], r["repeated"], r["inferred"]) for c, r in got.items()} == {
        "id": ("key", False, "numeric"), "name": ("who", False, "text"), "note": (None, False, "text"),
        "grade": ("result", False, "numeric"), "grade_1": (None, True, "numeric"), "extra": (None, False, "text")}
    assert {(r["can_import"], r["can_train"], r["can_score"]) for r in got.values()} == {(True, False, True)}
