"""Quotation links against a plain version, and the query against its SQL on planted quotes."""

import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from check_oracle import bag, compare, connect
from gridsurvey.llm import queries, quotes

LONG = "A first paragraph\nover two lines.\n\nAnd a Second one."
ROWS = [
    (1, 0, "user", LONG), (1, 1, "assistant", "> a first   paragraph over\n> two lines.\nI agree.\n\n"),
    (1, 2, "user", "On Monday someone wrote:\n> I agree.\n>> And a second one.\n> > never said\nFine\n\nby me"),
    (1, 3, "user", "Unrelated"), (1, 4, "assistant", ">>> i agree.\n\n> fine by nobody\n> \n> unrelated\nwell"),
    (1, 5, "user", "Unrelated"), (1, 6, "user", "> unrelated"), (1, 3000, "user", "> UNRELATED\nlate"), (1, 3001, "user", "> late"),
    (2, 0, "user", "> I agree."), (2, 1, None, None), (2, 2, "system", ""), (2, 3, "user", "   "), (2, 4, "user", "On it he wrote:\nno quote"),
    (2, 5, "user", "1 > 0\n >\tno quote\n>"), (3, 0, "user", "yes"), (3, 1, "user", "> yes\nyes"), (3, 2, "user", "> yes\nyes"),
    (3, 3, "user", "> yes\nyes"), (4, 7, "user", "> later words"), (4, 8, "user", "later words"), (5, 0, "user", "x\n" * 20_000),
]


def plain(rows):
    def parse(text):
        out = []
        for line in (text or "").split("\n"):
            prefix = re.match(r"^(?:[ \t]*>)+[ \t]?", line)
            prefix = prefix[0] if prefix else ""
            out.append((prefix.count(">"), line[len(prefix):]))
        return out

    def paragraphs(lines):
        runs, before = [], None
        for level, body in lines:
            if before and before[0] == level and body.strip(" ") and before[1].strip(" "):
                runs[-1][1].append(body)
            else:
                runs.append((level, [body]))
            before = level, body
        words = [(level, " ".join(" ".join(b).lower().split())) for level, b in runs]
        return [w for w in words if w[1]]

    said = {}
    for c, t, _, text in rows:
        for level, words in paragraphs(parse(text)):
            if level == 0:
                said.setdefault((c, words), set()).add(t)
    parent, out = {}, []
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        lines = parse(text)
        quoted = [(level, words, max((o for o in said.get((c, words), ()) if o < t), default=None)) for level, words in paragraphs(lines) if level]
        hits = [(level, -o) for level, _, o in quoted if o is not None]
        parent[c, t] = -min(hits)[1] if hits else None
        root, depth = t, 0
        while parent[c, root] is not None:
            root, depth = parent[c, root], depth + 1
        own = [b for k, (level, b) in enumerate(lines) if level == 0 and not (
            re.match(r"^\s*On\b.*\bwrote:\s*$", b) and k + 1 < len(lines) and lines[k + 1][0])]
        while own and not own[0].strip():
            own.pop(0)
        while own and not own[-1].strip():
            own.pop()
        out.append((c, t, role, root, parent[c, t], depth, len(quoted), len(hits), "\n".join(own),
                    [w for _, w, o in quoted if o is None]))
    return out


def test_same_as_plain_version(spark):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "conv_id bigint, turn bigint, role string, text string, formatted string, root_turn int")
    got = quotes.link_quotes(frame).orderBy("conv_id", "turn").collect()
    assert [tuple(r)[:10] for r in got] == plain(ROWS)
    assert all(r.formatted == f"<|{r.role or 'user'}|>\n{r.text}\n<|end|>\n" for r in got)
    ordered = [(r.conv_id, r.root_turn, r.turn) for r in quotes.in_reply_order(quotes.link_quotes(frame)).collect()]
    assert ordered == sorted(ordered)


def test_edge_rows(spark):
    rows = [(None, 0, "a", "x"), (1, None, "a", "> x"), (1, 0, "a", "x"), (1, 0, "a", "x"), (1, 1, "a", "> x\ny"), (1, 1, "a", "> x\ny")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = quotes.link_quotes(frame).collect()
    assert len(got) == len(rows)
    assert [r.parent_turn for r in got if r.conv_id == 1 and r.turn == 1] == [0, 0]
    assert all(r.parent_turn is None for r in got if r.turn != 1)
    assert quotes.link_quotes(frame.limit(0)).count() == 0


def test_query_agrees_with_sql(spark, small, tmp_path):
    name = "op10_chat_format"
    problem, rows, _ = compare(spark, connect(small), small, queries.QUERIES[name], queries.SQL[name])
    assert problem is None, problem
    assert rows > 0
    columns = list(zip(*ROWS))
    pq.write_table(pa.table({
        "conv_id": pa.array(columns[0], pa.int64()), "turn": pa.array(columns[1], pa.int64()),
        "role": pa.array(columns[2], pa.string()), "text": pa.array(columns[3], pa.string())}), tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    expected = con.execute(queries.SQL[name])
    names = [d[0] for d in expected.description]
    ours = queries.QUERIES[name](spark, str(tmp_path))
    assert bag(ours.columns, ours.collect()) == bag(names, expected.fetchall())
