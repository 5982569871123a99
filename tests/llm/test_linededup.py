"""Line dedup against the same rule in Python."""

from collections import defaultdict

from helpers import CLASH, documents, texts

from twinlake.llm import linededup




def kept(spark, rows, **kw):
    out = linededup.line_dedup(documents(spark, rows), **kw).collect()
    return {r.doc_id: r.text for r in out}


LONG = "a line of more than eight words that stands here"


def test_later_runs_go_and_first_stay(spark):
    a = "\n".join(["one", "two", "three", "four"])
    got = kept(spark, [(1, a), (2, f"x\n{a}\ny"), (3, "one\nz\ntwo"), (4, "  one \ntwo  \n\nthree\nw")])
    assert got == {1: a, 2: "x\ny", 3: "one\nz\ntwo", 4: "\nw"}


def test_long_line_is_a_run(spark):
    got = kept(spark, [(1, f"x\n{LONG}\n{LONG}"), (2, LONG), (3, f"p\n{LONG}\nq")])
    assert got == {1: f"x\n{LONG}", 2: "", 3: "p\nq"}


def test_two_short_lines_stay(spark):
    assert kept(spark, [(1, "a\nb\nc"), (2, "a\nb\nd")]) == {1: "a\nb\nc", 2: "a\nb\nd"}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, LONG), (4, LONG), (4, LONG), (5, "w\n" * 3000), (6, "v" * 200000)]
    got = linededup.line_dedup(documents(spark, rows, more=True)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].text is None and by[2].text == "" and by[3].text == "\n\n" and by[None].text == LONG
    assert [r.text for r in got if r.doc_id == 4] == ["", ""] and by[6].text == "v" * 200000
    assert all(by[2][c] == c for c in CLASH) and by[5].text.count("w") < 10
    assert linededup.line_dedup(documents(spark, [])).collect() == []


def test_whole_table_never_loses_a_line_or_adds_one(spark):
    rows = texts()
    out = {r.doc_id: r for r in linededup.line_dedup(documents(spark, rows)).collect()}
    assert len(out) == len(rows)
    every, left = defaultdict(int), defaultdict(int)
    for i, t in rows:
        assert (out[i].text is None) == (t is None)
        new, old = (out[i].text or "").split("\n"), iter((t or "").split("\n"))
        assert all(x in old for x in new) or new == [""]  # what stays stays in order
        for x in (t or "").split("\n"):
            every[x.strip(" ")] += 1
        for x in new:
            left[x.strip(" ")] += 1
    assert all(left[x] >= 1 for x in every if x)
    # a line of eight words or more is left once
    assert all(left[x] == 1 for x in every if len(x.split(" ")) >= 8)


def test_no_python_in_the_plan(spark):
    plan = linededup.line_dedup(documents(spark, texts()[:5]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute(rows, window=2, min_words=8, longest=6):
    """All runs of all lengths, each against every earlier place."""
    docs = [(i, [(k, x.strip(" ")) for k, x in enumerate(t.split("\n")) if x.strip(" ")], t.split("\n")) for i, t in sorted(rows)]
    seen, out = set(), {}
    for i, said, lines in docs:
        gone = set()
        for p in range(len(said)):
            for k in range(1, min(longest, len(said) - p) + 1):
                run = tuple(x for _, x in said[p : p + k])
                if k <= window and sum(x.count(" ") + 1 for x in run) < min_words:
                    continue
                if run in seen:
                    gone |= {at for at, _ in said[p : p + k]}
                seen.add(run)
        out[i] = "\n".join(x for at, x in enumerate(lines) if at not in gone)
    return out


def test_two_short_lines_of_eight_words(spark):
    two = "Erreth was ofretihaou the that edouhe.\nOf, edti oner."
    rows = [(1, two), (2, two), (3, f"x\n{two}\ny")]
    assert kept(spark, rows) == brute(rows) == {1: two, 2: "", 3: "x\ny"}


def test_run_whose_pairs_stand_first_elsewhere(spark):
    """Twenty times, for which pair of a run was looked at depended on its hash."""
    rows = []
    for g in range(20):
        rows += [(10 * g + k, "\n".join(f"{c}{g}" for c in t)) for k, t in enumerate(("abz", "ybc", "abc", "qabcr"))]
    got = kept(spark, rows)
    assert got == brute(rows)
    assert all(got[10 * g + 3] == f"q{g}\nr{g}" for g in range(20))


def test_runs_whose_pairs_each_stand_earlier(spark):
    """Forty runs of three lines in two documents; each of their pairs stands once in an earlier one."""
    rows = []
    for g in range(40):
        a, b, c = (f"{x} of {g}" for x in "abc")
        rows += [(4 * g, f"{a}\n{b}\nq{g}"), (4 * g + 1, f"r{g}\n{b}\n{c}"), (1000 + g, f"{a}\n{b}\n{c}"), (2000 + g, f"s{g}\n{a}\n{b}\n{c}\nt{g}")]
    got = kept(spark, rows)
    assert got == brute(rows)
    assert all(got[2000 + g] == f"s{g}\nt{g}" for g in range(40))


def test_very_many_lines(spark):
    """Two texts of 100,000 lines: the second goes, but for its own last line."""
    long = "\n".join(f"line {k % 5000} of {k // 7}" for k in range(100_000))
    got = kept(spark, [(1, long), (2, long + "\nends")])
    assert got[2] == "ends" and len(got[1]) <= len(long)


def test_random_lines_against_all_runs(spark):
    import random

    rng = random.Random(4)
    line = [" ".join("w" * (1 + k) for _ in range(n)) for k, n in enumerate((1, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9))]
    rows = [(i, "\n".join(rng.choice(line) for _ in range(rng.randrange(1, 9)))) for i in range(200)]
    for window, words in ((2, 8), (1, 8), (3, 12)):
        assert kept(spark, rows, window=window, min_words=words) == brute(rows, window, words)
    assert kept(spark, [(i, t) for i, t in texts() if t is not None]) == brute([(i, t) for i, t in texts() if t is not None])
