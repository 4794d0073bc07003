"""

usage: python tools/bench_table.py bench.json
"""
import json
import sys


def main():
    b = json.loads(open(sys.argv[1]).read().strip().splitlines()[-1])
    q = b["queries"]
    print(f"sf {b['sf']}, local[{b.get('cpus', '?')}], {len(q)} jobs, sum of medians **{b['value']:.1f} s**\n")
    print("| job | s | job | s | job | s |")
    print("|---|---|---|---|---|---|")
    items = sorted(q.items(), key=lambda kv: -kv[1])
    for i in range(0, len(items), 3):
        row = items[i:i + 3] + [("", None)] * (3 - len(items[i:i + 3]))
        print("| " + " | ".join(f"{k} | {v:.2f}" if v is not None else " | " for k, v in row) + " |")


if __name__ == "__main__":
    main()
