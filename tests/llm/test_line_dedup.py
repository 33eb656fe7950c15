"""Line windows against a plain version, on edge cases and made-up tables, and the query against its SQL."""

import random

from check_oracle import compare, connect
from gridsurvey.llm import line_dedup, queries

SCHEMA = "doc_id bigint, text string, lines int, covers string"


def plain(rows):
    places, cut = {}, []
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        filled = [k for k, line in enumerate(lines) if line.strip(" ")]
        for a, b, c in zip(filled, filled[1:], filled[2:]):
            key = tuple(lines[k].strip(" ") for k in (a, b, c))
            if places.setdefault(key, (i, text, a)) != (i, text, a):
                cut.append((i, text, range(a, c + 1)))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = {k for j, t, r in cut if (j, t) == (i, text) for k in r}
        kept = "\n".join(line for k, line in enumerate(lines) if k not in gone) if gone else text
        out.append((i, 0 if text is None else len(lines), len(gone), kept))
    return sorted(out, key=str)


def test_same_as_plain_version(spark):
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice("ABCDEF  ") for _ in range(r.randrange(30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "one"), (103, "a\nb"), (104, " x \ny\n\nz"), (105, "x\ny \nz\n\n"), (106, "A\n" * 30),
             (107, "long\n" * 20_000), (108, "twice\nin\none\ndoc"), (108, "twice\nin\none\ndoc"), (109, "twice\nin\none"), (None, "x\ny\nz")]
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], SCHEMA)
    assert sorted(map(tuple, line_dedup.remove_repeated_lines(docs).collect()), key=str) == plain(rows)
    assert line_dedup.remove_repeated_lines(docs.limit(0)).count() == 0


def test_query_agrees_with_sql(spark, small):
    problem, rows, _ = compare(spark, connect(small), small, queries.QUERIES["op2_line_dedup"], queries.SQL["op2_line_dedup"])
    assert problem is None, problem
    assert rows > 0
