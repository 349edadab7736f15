"""Set lines and cuts of odd pages, and how they are moved."""

import collections

from docketry import registry
from docketry.operators import layout as L
from docketry.plans import layout as PL

Q = registry.queries()


def test_a_cut_is_one_pass_with_one_shuffle(spark, sf_dir):
    """Levels are steps inside a page's row: no rounds of windows, joins and stored tables, and a page is moved once, with its lines."""
    plan = Q["w18_xy_cut"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "xycut" not in plan


LINES = [
    "one line", "  a  b   c ", " ", "", "x" * 47 + " y", "x" * 48 + " y", "x" * 49 + " y z", "w" * 300 + " " + "v" * 99 + " u t", "ab " * 40, "a" * 24 + " " + "b" * 23 + " c",
    "tab\tstays \t in its word", "carriage\rreturn and separator " * 5, "\U0001f600\U0001f601 " * 60, "漢字" * 70 + " 漢", "m" * 200_000, "k " * 3_000, "end at a break " + "q" * 32 + " ",
]


def test_pieces_of_odd_lines(spark, tmp_path):
    """Words that begin within the same width are a piece, whatever stands over its ends: breaks inside words, at spaces and at the end; long words and lines."""
    docs = {d: "\n".join(LINES[d:] + LINES[:d]) for d in range(0, 12)} | {12: None, 13: "", 14: "\n".join(["alpha beta gamma " * 9] * 95)}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    words, pieces = set(), {}
    for d, text in docs.items():
        for n, line in enumerate((text or "").split("\n")):
            at, key = 0, (d, n // 40 + 1, n % 40)
            wide = 500 if n % 40 == 0 or d % 2 else 240
            for k, word in enumerate(w for w in line.split(" ") if w):
                words.add((*key, 5 * at // wide, k, word, 5.0 * at, 5.0 * len(word)))
                pieces.setdefault((*key, 5 * at // wide), []).append((at, word))
                at += len(word) + 1
    x = lambda r, c: r[c] - 300 * r["col"] + r["sub"] * (500 if r["line_no"] == 0 or r["doc_id"] % 2 else 240)
    got = PL.set_words(spark, str(tmp_path)).collect()
    assert len(got) == len(words) and {(r["doc_id"], r["page"], r["line_no"], r["sub"], r["k"], r["str"], x(r, "x"), r["w"]) for r in got} == words
    want = {(*key, " ".join(w for _, w in p), 5.0 * p[0][0], 5.0 * (p[-1][0] + len(p[-1][1]))) for key, p in pieces.items()}
    got = PL.set_lines(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["page"], r["line_no"], r["sub"], r["text"], x(r, "x1"), x(r, "x2")) for r in got} == want
    seqs = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["page"], r["line_no"], r["sub"])):
        seqs[r["doc_id"], r["page"]].append(r["seq"])
    assert all(s == list(range(1, len(s) + 1)) for s in seqs.values())


def test_cuts_of_pages_without_a_number(spark):
    """Pages are told apart by their keys, a missing one being a key as well; an item without a place goes to the second side."""
    items = [(None, 1, k, 0.0, 700.0 - 20 * k, 100.0, 10.0, "a") for k in range(8)] + [(7, None, k, 300.0 * (k % 2), 700.0 - 12 * (k // 2), 200.0, 10.0, "a") for k in range(20)] + [(7, None, 20, None, 500.0, 50.0, 10.0, "a")]
    got = collections.defaultdict(dict)
    for r in L.xy_cut(spark.createDataFrame(items, "doc_id long, page long, item long, x double, y double, w double, h double, str string")).collect():
        got[r["doc_id"], r["page"]][r["item"]] = r["block"]
    assert got[None, 1] == {7: "2", 6: "12", 5: "112", 4: "1112", **{k: "1111" for k in range(4)}}
    assert set(got) == {(None, 1), (7, None)} and len(got[7, None]) == 21 and got[7, None][20].startswith("2")
