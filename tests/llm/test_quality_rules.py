import re

from tablespec.llm import quality_rules as Q
from tests.llm.common import awkward, frame, text
from tests.oracles import agrees

WORD = r"[^\x20\x09-\x0D]+"


def measures(x):
    x = x or ""
    w = re.findall(WORD, x)
    seen, dup = set(), 0
    for line in x.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    spots = {}
    for i in range(len(w) - 7):
        spots.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeat = {p for s in spots.values() if len(s) > 1 for i in s for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), dup, len(repeat)


def test_measures_equal_plain_ones(spark):
    extra = [(50, "a b\n\na b\n a b\na b", "en", "a"), (51, "#|<> *$%& " * 30, "en", "a"), (52, "\n".join([text(9, 12)] * 5), "en", "b"), (53, "x\n" * 40, "en", "a")]
    rows = awkward() + extra
    got = Q.quality_rules(frame(spark, rows), carry=("text",)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_common_lines_deplete(spark):
    line = text(77, 25)
    shared = [(i, f"{line}\n{text(i, 8)}", "en", "h") for i in range(60)]
    rich = [(100 + i, f"{line}\n{text(100 + i, 60)}", "en", "h") for i in range(60)]
    copies = [(200 + i, text(5, 40), "en", "h") for i in range(80)]
    got = {r.doc_id: r for r in Q.quality_rules(frame(spark, shared + rich + copies)).collect()}
    assert not any(got[i].kept for i in range(60))
    assert all(got[100 + i].kept and got[100 + i].removed_words == 25 for i in range(60))
    assert all(got[200 + i].kept for i in range(80))


def test_common_lines_are_removed_from_the_text(spark):
    """Against plain splitting, with common lines first, last, alone and twice, and blank lines between."""
    line, other = text(7777, 25), "Ünder the é bar"
    shapes = ["{a}\n{t}", "{t}\n{a}", "{t}\n\n{b}\n{a}", "  {a} \n\n{t}\n{b}\n", "{b}\n{A}\n{t}\n{b}", "\n{b}\n{t}\r\n{a}\r\n"]
    rows = [(i, shapes[i % 6].format(a=line, b=other, A=line.upper(), t=text(i, 60)), "en", "h" if i % 3 else None) for i in range(240)]
    rows += [(1000 + i, f"{line}\n{text(i, 8)}", "en", "h") for i in range(30)] + [(2000 + i, f"{line}\n{text(i, 60)}", "en", "small") for i in range(5)]
    rows += [rows[0], (rows[1][0], rows[1][1], "en", "small")]
    common = {line, "Ünder the é bar"}
    fold = lambda x: x.strip(" \t\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    want = []
    for i, x, _, host in rows:
        if not 1000 <= i < 2000:
            want.append((i, host, x if host == "small" else "\n".join(p for p in x.split("\n") if fold(p) not in common)))
    got = Q.clean_documents(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    got = got.collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.source, r.text)) for r in got)
    assert all(r.n_chars == len(r.text) for r in got)


def test_no_rows(spark):
    assert Q.quality_rules(frame(spark, awkward()).limit(0)).count() == 0


def test_query_equals_sql(spark):
    agrees(Q.op6_quality_rules(spark, "/root/testdata/sf0.001"), Q.ORACLE, "/root/testdata/sf0.001")
