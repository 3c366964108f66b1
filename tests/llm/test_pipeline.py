import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as C
from tablespec.llm.mixing import BLOCK, ORACLE, mix_sources
from tablespec.llm.secrets import KINDS
from tablespec.llm.shared import written
from tests.llm.common import awkward, frame, table, text
from tests.llm.test_jaccard import shingles

COPY = text(31, 60)
SECRET = "Zx9Qw3Er7Ty1Ui5Op2AsB4"


def corpus():
    rows = awkward() + [(500 + i, text(500 + i, 60 + i), "en", f"s{i % 4}") for i in range(60)]
    rows += [(600 + i, COPY, "en", "s1") for i in range(12)] + [(620, COPY.replace(" ", "  "), "en", "s2"), (621, COPY + " tail", "en", "s2")]
    return rows + [(700, f"{text(701, 40)} password: {SECRET} {text(702, 20)}", "en", "s3")]


def run_stages(spark, docs, upto):
    for _, stage in C.STAGES[:upto]:
        docs = written(stage(spark, docs, ""))
    return docs


def test_each_stage_takes_effect(spark):
    docs = frame(spark, corpus())
    ruled = run_stages(spark, docs, 1)
    assert ruled.columns == list(C.COLUMNS)
    words = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x or "")
    assert all(len(words(r.text)) >= 20 for r in ruled.collect())
    assert {r.doc_id for r in ruled.collect()} >= {500 + i for i in range(60)} | {600 + i for i in range(12)} | {620, 621, 700}
    single = C.jaccard_stage(spark, ruled, "").collect()
    assert len([r for r in single if r.text.startswith(COPY[:40]) or r.text == COPY]) == 1
    assert {r.doc_id for r in single} >= {500 + i for i in range(60)} | {700}
    assert Counter((r.doc_id, r.text) for r in single).most_common(1)[0][1] == 1
    masked = {r.doc_id: r for r in C.secrets_stage(spark, ruled, "").collect()}
    assert SECRET not in masked[700].text and C.PLACEHOLDER in masked[700].text and masked[700].n_chars == len(masked[700].text)
    assert masked[510].text == text(510, 70)
    mixed = C.mixing_stage(spark, ruled, "").collect()
    assert max(Counter((r.doc_id, r.text) for r in mixed).values()) <= 3 * 2  # a repeated row may be taken three times itself
    assert {r.source for r in mixed} == {r.source for r in ruled.collect()}


def test_quality_stage_removes_common_lines(spark):
    line = text(7777, 25)
    docs = frame(spark, [(i, f"{line}\n{text(i, 60)}", "en", "h") for i in range(60)])
    got = C.quality_stage(spark, docs, "").collect()
    assert len(got) == 60 and all(r.text == text(r.doc_id, 60) and r.n_chars == len(r.text) for r in got)


def test_mixing_stage_keeps_each_source_near_its_words(spark):
    """Within its largest document, whether it has many documents, few, or one that is very long."""
    rows = [(i, text(i, 50 + i % 150), "en", f"s{i % 5}") for i in range(1000)] + [(2000 + i, text(i, 100), "en", "t") for i in range(6)] + [(3000, text(5, 9000), "en", "s1"), (3001, text(6, 70), "en", None)]
    docs = frame(spark, rows)
    want, most, got, times = Counter(), Counter(), Counter(), Counter()
    for r in mix_sources(docs, carry=("source",)).collect():
        want[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
    for r in C.mixing_stage(spark, docs, "").collect():
        got[r.source] += len(r.text.split())
        times[r.doc_id] += 1
    # the stage seeds by its own key: what it takes of a source differs by some blocks
    assert all(abs(got[s] - want[s]) <= most[s] + 3 * BLOCK for s in want)
    assert max(times.values()) <= 3


def test_run_gives_windows(spark, tmp_path):
    got = C.run(spark, table(spark, corpus(), tmp_path)).collect()
    assert got and all(0 < r.length <= 1024 and r.sequence_tokens <= 1024 for r in got)


def test_stages_take_no_rows(spark):
    docs = frame(spark, corpus()).limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is C.run
    assert {f"op{n}" for n in (1, 2, 3, 4, 5, 6, 8, 9, 10)} <= {q.split("_")[0] for q in entry.queries()}


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def brute_rules(rows):
    """(id, text, lang, source) kept, without their host's common lines."""
    words = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x)
    normal = lambda line: line.strip(SPACES).translate(LOW)
    texts, held = defaultdict(set), defaultdict(set)
    for _, x, _, host in rows:
        texts[host].add(x)
        for line in x.split("\n"):
            if words(line):
                held[host, normal(line)].add(x)
    common = {k for k, v in held.items() if len(v) > 20 and len(v) > 0.1 * len(texts[k[0]])}
    out = []
    for i, x, lang, host in rows:
        w = words(x)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        gone = sum(len(words(line)) for line in x.split("\n") if words(line) and (host, normal(line)) in common)
        if len(w) >= 20 and 100 * len(again) <= 30 * len(w) and not (gone >= 0.5 * len(w) and len(w) - gone < 20):
            out.append((i, "\n".join(line for line in x.split("\n") if not (words(line) and (host, normal(line)) in common)), lang, host))
    return out


def brute_single(rows):
    sets = {r[0]: shingles(r[1], C.NEAR_WORDS) for r in rows}
    component = {r[0]: r[0] for r in rows}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= C.NEAR_PERCENT * len(sets[a] | sets[b]) and component[a] != component[b]:
                old, new = component[b], component[a]
                component = {k: new if v == old else v for k, v in component.items()}
    best = {}
    for i, c in component.items():
        best[c] = min(best.get(c, (0, i)), (-len(sets[i]), i))
    return [r for r in rows if r[0] in {i for _, i in best.values()}]


def brute_masked(rows):
    spans = defaultdict(list)
    for i, x, _, source in rows:
        for no, (_, pattern, group, least) in enumerate(KINDS):
            for m in re.finditer(pattern, x):
                if len(m[group]) >= least and (no < 3 or re.search("[a-z]", m[group]) and re.search("[A-Z]", m[group]) and re.search("[0-9]", m[group])):
                    spans[i].append((m.start(), m.end(), no, m[group], source))
    clear = {i: [s for s in v if s[2] < 3 or not any(o[2] < 3 and o[0] < s[1] and o[1] > s[0] for o in v)] for i, v in spans.items()}
    owners, repos = defaultdict(set), defaultdict(set)
    for i, v in clear.items():
        for s in v:
            owners[s[3]].add(s[4])
            repos[s[3]].add((s[4], i))
    out = []
    for i, x, lang, source in rows:
        at, parts = 0, []
        for a, b, _, value, _ in sorted(clear.get(i, [])):
            if len(owners[value]) <= 1 and len(repos[value]) <= 5:
                if a >= at:
                    parts += [x[at:a], C.PLACEHOLDER]
                at = max(at, b)
        out.append((i, "".join(parts) + x[at:], lang, source))
    return out


def brute_mixed(keyed):
    """Times of each key, for (key, text, source): the op2 SQL's words, rounded along each source."""
    import duckdb
    import pyarrow as pa

    documents = pa.table({"doc_id": [k for k, _, _ in keyed], "text": [x for _, x, _ in keyed], "source": [s for _, _, s in keyed]})
    con = duckdb.connect()
    con.register("documents", documents)
    taken = {r[0]: (r[1], r[4]) for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLE})").fetchall()}
    lines = defaultdict(list)
    for k, _, s in keyed:
        size, t = taken[k]
        seed = int(hashlib.md5(f"mix-1:{k}:copy".encode()).hexdigest()[:15], 16)
        lines[s].append((size, seed, k, math.floor(t * 2**30 / size + 0.5)))
    times = {}
    for line in lines.values():
        at = 2**29
        for _, _, k, share in sorted(line):
            times[k] = (at + share) // 2**30 - at // 2**30
            at += share
    return times


def test_stages_equal_a_brute_force_version(spark):
    from pyspark.sql import functions as F

    r = random.Random(9)
    line = text(7777, 12)
    rows = [(i, f"{text(i, 30 + i % 60)}\n{line if i % 3 == 0 else text(5000 + i, 6)}", "en", f"s{i % 3}") for i in range(150)]
    rows += [(200 + i, text(i, 30 + i % 60) + f"\n{text(5000 + i, 6)}" + r.choice(["", " more", " and more words here"]), "en", "s1") for i in range(0, 60, 4)]
    rows += [(300 + i, f"{text(900 + i, 40)} token = {SECRET if i % 2 else 'example0123456789Widely'} {text(950 + i, 20)}", "en", f"s{i % 3}") for i in range(12)]
    rows += [(400, text(41, 10), "en", "s0"), (401, (text(42, 9) + " ") * 12, "en", "s0"), (402, line + "\n" + text(43, 15), "en", "s0")]
    docs, want = frame(spark, rows), rows
    for (_, stage), brute in zip(C.STAGES[:3], (brute_rules, brute_single, brute_masked)):
        docs, want = written(stage(spark, docs, "")), brute(want)
        assert sorted((x.doc_id, x.text, x.lang, x.source) for x in docs.collect()) == sorted(want)
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text", F.concat(F.lit("s"), F.col("source"))).alias("k"), "text", "source").collect()
    times = brute_mixed([(x.k, x.text, x.source) for x in keyed])
    mixed = written(C.mixing_stage(spark, docs, ""))
    assert Counter(x.doc_id for x in mixed.collect()) == Counter({x.doc_id: times[x.k] for x in keyed if times[x.k]})
    pieces = C.packing_stage(spark, mixed, "").collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(x.doc_id for x in mixed.collect())
