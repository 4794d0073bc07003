"""Incremental secret scan over a history of files, with a ledger of what has been scanned.

Every version of every file is addressed by the SHA-256 of its text (its blob).  The ledger, Parquet batches in a folder,
has a row (blob, kind, version, spans) for each blob and rule version scanned, also where nothing
was found.  A scan gives the versions their blobs, takes the (blob, rule version) pairs that the ledger
lacks, fetches one text for each blob with such pairs and looks for their rules alone.  Findings are then joined
from the ledger to all paths that ever held the blob.  A new rule version is a new pair, so only that rule runs again.

A batch counts once its write has been committed, and a repeated batch of the same name is not written again, so a scan that was
broken off can simply be run again.  Only one row for each blob carries its text through a shuffle; copies
are dropped by (path, blob) before it is scanned.

Defined results: a null text is the empty text; spans are whole matches as code points, end exclusive,
leftmost and not overlapping for each rule; a match whose measured group is too short is dropped but its characters
stay used; a repeated path is one more row of the result; null paths are kept; an empty table gives no rows;
other columns are ignored.  Bytes that are no UTF-8 count as one replacement character each.
"""
from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

LEDGER = "blob binary, kind string, version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: group `group` of a match has `least` characters at least; a text with none of `needs` has no match."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()
    base: bool = False


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

#: The production rules, in the order in which spans at one place are listed.
RULES = (
    Rule("assign", 1, rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, base=True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=20, needs=("AKIA",), base=True),
    Rule("hex", 1, r"[0-9a-f]{24,}", least=24, base=True),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", needs=("PRIVATE KEY-----",)),
    Rule("forge_token", 1, r"gh[opsu]_[A-Za-z0-9]{36,}", needs=("gho_", "ghp_", "ghs_", "ghu_")),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
)


def find(rule: Rule, text: str) -> list[dict[str, int]]:
    if rule.needs and not any(n in text for n in rule.needs):
        return []
    return [{"start": m.start(), "end": m.end()} for m in re.finditer(rule.pattern, text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def address(text_col: str) -> Column:
    """The blob of a text: its SHA-256 (binary)."""
    return F.unhex(F.sha2(text_or_empty(text_col), 256))


def _pairs(rules: Sequence[Rule]) -> Column:
    return F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])


class Ledger:
    """Scanned (blob, rule version) pairs and their findings, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _batches(self) -> list[str]:
        """Committed batches."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(f.getPath().getParent().toString() for f in found or [])

    def rows(self) -> DataFrame:
        paths = self._batches()
        return self.spark.read.schema(LEDGER).parquet(*paths) if paths else self.spark.createDataFrame([], LEDGER)

    def scan(self, versions: DataFrame, rules: Sequence[Rule], batch: str) -> DataFrame:
        """Scan what is new in `versions` (path, text) and give (path, blob) of every row; nothing if `batch` has been committed."""
        names = [r.kind for r in rules]
        if len(set(names)) < len(names) or not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("rules need distinct kinds, batches plain names")
        held = materialise(versions.select("path", address("text").alias("blob")), "ledger-paths")
        target = f"{self.folder}/batch={batch}"
        if not any(b.endswith(f"/batch={batch}") for b in self._batches()):
            self._unseen(versions, held, rules).write.mode("overwrite").parquet(target)
        return held

    def _unseen(self, versions: DataFrame, held: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        wanted = _pairs(rules)
        current = self.rows().where(F.array_contains(wanted, F.struct("kind", "version")))
        seen = current.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))  # at most one for each rule
        blobs = held.groupBy("blob").agg(F.min(F.struct("path")).alias("holder"))
        todo = blobs.join(seen, "blob", "left").select("blob", "holder", F.when(F.col("seen").isNull(), wanted).otherwise(F.array_except(wanted, "seen")).alias("todo"))
        todo = todo.where(F.size("todo") > 0).select("blob", "holder", F.transform("todo", lambda t: t["kind"]).alias("todo"))
        texts = versions.select(F.struct("path").alias("holder"), address("text").alias("blob"), text_or_empty("text").alias("text"))
        by_kind = {r.kind: r for r in rules}
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = set()
            for batch in batches:
                blobs, kinds, found = [], [], []
                for blob, raw, todo in zip(batch.column("blob").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("todo").to_pylist(), strict=True):
                    if blob in last:  # the same row of the table twice
                        continue
                    last = {blob}
                    text = raw.as_py().decode("utf-8", "replace")
                    for kind in todo:
                        blobs.append(blob)
                        kinds.append(kind)
                        found.append(find(by_kind[kind], text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blobs, pa.binary()), pa.array(kinds, pa.string()), pa.array([by_kind[k].version for k in kinds], pa.int32()), pa.array(found, spans_type)],
                    names=["blob", "kind", "version", "spans"])

        due = texts.join(todo, (texts["holder"].eqNullSafe(todo["holder"])) & (texts["blob"] == todo["blob"])).select(todo["blob"], "text", "todo")
        return due.mapInArrow(run, LEDGER)

    def findings(self, rules: Sequence[Rule]) -> DataFrame:
        """(blob, found): for each blob with findings of these rule versions, array of (start, place, end, kind) in the order of the spans."""
        place = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
        rows = self.rows().where((F.size("spans") > 0) & F.array_contains(_pairs(rules), F.struct("kind", "version")))
        rows = rows.groupBy("blob", "kind").agg(F.first("spans").alias("spans"))  # a pair may have been scanned twice, alike
        of_rule = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place[F.col("kind")].alias("place"), s["end"].alias("end"), F.col("kind").alias("kind")))
        return rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(of_rule))).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, folder: str, batch: str, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan a table as one batch of the ledger in `folder`: (id, n_<kind> of each base rule, base_sha256, spans) of every row."""
    ledger = Ledger(docs.sparkSession, folder)
    held = ledger.scan(docs.select(F.col(id_col).alias("path"), F.col(text_col).alias("text")), rules, batch)
    base = [r.kind for r in rules if r.base]
    found = F.col("found")

    def count(kind: str) -> Column:
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    of_blob = ledger.findings(rules).select(
        "blob", *[count(kind) for kind in base],
        _joined(F.filter(found, lambda s: s["kind"].isin(base))).alias("base"), _joined(found).alias("spans"))
    rows = held.join(of_blob, "blob", "left")
    return rows.select(
        F.col("path").alias(id_col), *[F.coalesce(f"n_{kind}", F.lit(0).cast("long")).alias(f"n_{kind}") for kind in base],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
