import os
from collections import defaultdict

import pytest

from evidra.llm import linededup

from . import frames

BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_docs=5, min_chars=40):
    holders = defaultdict(list)
    for d, text in rows:
        for k in {key_of(x) for x in (text or "").split("\n")}:
            holders[k].append(d)
    out = []
    for d, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            k = key_of(line)
            last = max((x for x in holders[k] if x is not None), default=None)
            repeated = len(k) >= min_chars and len(holders[k]) >= min_docs and d != last
            kept += [] if repeated else [line]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def run(df, **options):
    return sorted(((r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in linededup.dedup_lines(df, **options).collect()), key=repr)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (5, 3)])
def test_like_brute_force_in_any_batches(spark, batches, fanout):
    lines = [f"{'Common line with a number that makes it long'} {i}" for i in range(4)]
    rows = [(i, "\n".join([lines[i % 4], f"\t{lines[(i * i) % 4].upper()} ", "short", f"own {i} " * 9])) for i in range(40)]
    rows += [(r[0], r[1]) for r in frames.EDGE]
    assert run(frames.docs(spark, rows), batches=batches, fanout=fanout) == brute(rows)


def test_documents_keep_their_columns(spark):
    df = frames.docs(spark, frames.EDGE)
    out = linededup.deduped_documents(df)
    assert out.columns == df.columns
    rows = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert rows[20].text == "own words 0" and rows[20].n_chars == len("own words 0")
    assert rows[30].text == f"  {frames.LINE.upper()}\t" and rows[1].text is None
    assert linededup.deduped_documents(frames.docs(spark, [])).collect() == []


def test_runs_compact_by_level_and_hold_each_hash_once(spark):
    runs = linededup.LineRuns(spark, fanout=2, buckets=3)
    for i in range(5):
        df = frames.docs(spark, [(10 * i + j, "\n".join([frames.LINE, f"{frames.LINE} of batch {i // 2}", f"{frames.LINE} {i} {j}"])) for j in range(2)], clashes=False)
        runs.add(linededup.long_lines(df, 1).filter("fresh").select("h1", "h2", "k"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert runs.added == [4, 2, 3, 2, 3] and len(runs.hits) == 4  # what each batch brings that no run has
    rows = [r for name in runs.runs() for r in spark.table(name).collect()]
    assert len({(r.h1, r.h2) for r in rows}) == len(rows) == sum(runs.added)
    assert sorted((r.n_docs, r["last"]) for r in runs.totals().collect() if r.n_docs > 1) == [(2, 41), (4, 11), (4, 31), (10, 41)]
    anti = spark.table(runs.runs()[0]).select("h1", "h2").join(spark.table(runs.runs()[1]).hint("merge"), ["h1", "h2"], "left_anti")
    plan = anti._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # runs are dealt out alike and do not move
    names, folder = runs.runs(), runs.folder.removeprefix("file:")
    runs.remove()
    assert not any(spark.catalog.tableExists(n) for n in names) and not os.path.exists(folder)


def test_one_key_with_many_texts(spark):
    lines = [f"{'Common line with a number that makes it long'} {i}" for i in range(6)]
    rows = [(None if i % 3 else 5, "\n".join([lines[i % 6], f"own {i}", lines[(i + 1) % 6]])) for i in range(60)] + [(9, "\n".join(lines))]
    assert run(frames.docs(spark, rows)) == brute(rows)
