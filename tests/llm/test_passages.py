"""Repeated paragraphs and passages against brute force with its own splitting, and on odd rows."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from panelyard.llm import paragraphs

SF = "/root/testdata/sf0.001"
MIN, RUN, WHOLE, COMMON = 10, 12, 40, 10
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def _words(text):
    return [(m.start(), m.end(), _lower(m[0])) for m in WORD.finditer(text or "")]


def _paragraphs(text):
    """(start, end, words) of lines and of blocks between blank lines."""
    at, lines = 0, []
    for line in (text or "").split("\n"):
        lines.append([(at + s, at + e, w) for s, e, w in _words(line)])
        at += len(line) + 1
    out, block = [line for line in lines if line], []
    for line in [*lines, []]:
        if line:
            block.append(line)
            continue
        if any(len(x) >= 5 for x in block):
            while len(block[0]) < 5:
                block = block[1:]
            while len(block[-1]) < 5:
                block = block[:-1]
        if len(block) > 1:
            out.append([w for x in block for w in x])
        block = []
    return [(p[0][0], p[-1][1], tuple(w for *_, w in p)) for p in out if len(p) >= MIN]


def _roots(n, pairs):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def _brute_paragraphs(docs):
    """{(doc, start, end, keeper, removed)} of all classes with several occurrences."""
    found, names = [], {}
    for d, text in docs:
        found += [(names.setdefault(w, len(names)), d, s, e, len(w), text) for s, e, w in _paragraphs(text)]
    sets = [{w[i : i + 5] for i in range(len(w) - 4)} for w in names]
    holders = defaultdict(set)
    for i, own in enumerate(sets):
        for x in own:
            holders[x].add(i)
    near = {(i, j) for group in holders.values() for i in group for j in group if i < j}
    pairs = [(i, j) for i, j in near if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    groups, root = defaultdict(list), _roots(len(sets), pairs)
    for n, d, s, e, k, t in found:
        groups[root[n]].append((d is None, d or 0, s, k, e, d, t))
    out = []
    for own in groups.values():
        if len(own) > 1:
            own.sort()
            common = len({g[5:] for g in own}) >= COMMON
            out += [(d, s, e, own[0][5], i > 0 and (k >= WHOLE or common)) for i, (_, _, s, k, e, d, _) in enumerate(own)]
    return sorted(out, key=str)


def _grams(docs, n):
    """{words: [(row, first word)]} of the n-grams."""
    out = defaultdict(list)
    for i, (_, text) in enumerate(docs):
        w = [x for *_, x in _words(text)]
        for k in range(len(w) - n + 1):
            out[tuple(w[k : k + n])].append((i, k))
    return out


@pytest.fixture(scope="module")
def table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    return rows, paragraphs.passages(docs).collect()


def test_paragraphs_match_brute_force_on_the_whole_table(table):
    rows, got = table
    want = _brute_paragraphs(rows)
    own = {(d, s, e) for d, t in rows for s, e, _ in _paragraphs(t)}
    spans = [g for g in got if (g.doc_id, g.start, g.end) in own]
    have = {(g.doc_id, g.start, g.end, g.keeper_doc_id, g.removed) for g in spans}
    assert len(want) > 50 and set(want) <= have


def test_repeated_words_are_found_and_nothing_else(table):
    rows, got = table
    at = {d: i for i, (d, _) in enumerate(rows)}
    words = [_words(t) for _, t in rows]
    covered = [np.zeros(len(w), bool) for w in words]
    gone = [np.zeros(len(w), bool) for w in words]
    for g in got:
        i = at[g.doc_id]
        inside = np.array([g.start <= s and e <= g.end for s, e, _ in words[i]])
        assert inside.sum() == g.n_words >= MIN  # spans are whole words
        assert words[i][int(inside.argmax())][0] == g.start
        covered[i] |= inside
        if g.removed:
            gone[i] |= inside
    n = 2 * RUN - 1
    long = {k: v for k, v in _grams(rows, n).items() if len(v) > 1}
    assert len(long) > 500
    for places in long.values():
        for i, k in places:
            assert covered[i][k : k + n].any()  # every occurrence of a repeated passage
    asked = [covered[i][k : k + n] for places in long.values() for i, k in places]
    assert np.mean(np.concatenate(asked)) > 0.98
    whole = [v for v in _grams(rows, WHOLE).values() if len(v) > 1]
    asked = [gone[i][k : k + WHOLE] for places in whole for i, k in sorted(places)[1:]]
    assert len(whole) > 200 and np.mean(np.concatenate(asked)) > 0.98
    # what is removed repeats an earlier place, or is a near copy of a paragraph
    first = _grams(rows, RUN)
    repeat = [np.zeros(len(w), bool) for w in words]
    for places in first.values():
        for i, k in sorted(places)[1:]:
            repeat[i][k : k + RUN] = True
    near = {(d, s, e) for d, s, e, _, removed in _brute_paragraphs(rows) if removed}
    for d, s, e in near:
        repeat[at[d]] |= np.array([s <= x and y <= e for x, y, _ in words[at[d]]])
    assert not any((g & ~r).any() for g, r in zip(gone, repeat, strict=True))


def _texts(n, size=50):
    rng = np.random.default_rng(size)
    words = lambda k: [f"w{x}" for x in rng.integers(0, 100_000, k)]
    for k in range(n):
        passage = words(size)
        heads = [words(int(rng.integers(60, 100))) for _ in range(2)]
        tails = [words(int(rng.integers(60, 100))) for _ in range(2)]
        yield passage, [(2 * k + c, " ".join(heads[c] + passage + tails[c]), heads[c], tails[c]) for c in (0, 1)]


def _runs(text):
    own = paragraphs.Text(text.encode())
    return {own.words(a, a + RUN) for a in paragraphs.anchors(own.hashes()).tolist()}


def test_every_passage_of_23_words_has_a_common_run_and_runs_touch():
    for _, rows in _texts(500, paragraphs.ANCHOR_WINDOW + paragraphs.RUN_WORDS - 1):
        assert _runs(rows[0][1]) & _runs(rows[1][1])
        own = paragraphs.Text(rows[0][1].replace(" ", "\n", 40).replace("w", "W", 30).encode())
        at = paragraphs.anchors(own.hashes())
        assert np.diff(at).max() <= paragraphs.RUN_WORDS and _runs(own.text.decode()) == _runs(rows[0][1])


def test_equal_runs_and_only_they_have_equal_hashes():
    rng = np.random.default_rng(5)
    own = paragraphs.Text(" ".join(f"w{x}" for x in rng.integers(0, 3, 20_000)).encode())
    at = np.arange(len(own.starts) - RUN + 1)
    words = [own.words(a, a + RUN) for a in at.tolist()]
    names = paragraphs.run_hashes(own.hashes(), at).tolist()
    assert len(set(words)) == len(set(names)) == len(set(zip(words, names, strict=True)))


def test_signatures_are_the_least_of_each_hash_over_tiles():
    rng = np.random.default_rng(6)
    sizes = np.array([1, 3, 40_000, 2, 16_384, 5])
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in sizes]
    got = paragraphs.minima(np.concatenate(sets), sizes, 7)
    want = [[min((int(x) * int(m) + int(a)) % (1 << 64) for x in own) for m, a in zip(paragraphs._MUL[:7], paragraphs._ADD[:7], strict=True)] for own in sets]
    assert got.tolist() == want


def _odd_texts(n):
    rng = np.random.default_rng(17)
    made = [" ".join(rng.choice(["a", "b", "ß", "\n", "\n\n", "c d e f g h", "Z\t"], k)) for k in rng.integers(0, 80, n).tolist()]
    return ["", "\n\n", "É " * 23, "x" * 300_000 + " W" * 30, *made, " ".join(f"v{k % 977}" for k in range(60_000))]


def test_texts_read_together_are_as_read_alone():
    texts = [t.encode() for t in _odd_texts(600)]
    seen = 0
    for i, j in paragraphs.together(texts):
        own = paragraphs.Texts(texts[i:j])
        hashes, parts = own.hashes(), own.paragraphs()
        at, rows = paragraphs.anchors(hashes, own.bounds), own.rows(parts[:, 0])
        runs = paragraphs.run_hashes(hashes, at)
        for k, t in enumerate(texts[i:j]):
            alone, first = paragraphs.Text(t), own.bounds[k]
            assert hashes[first : own.bounds[k + 1]].tolist() == alone.hashes().tolist()
            want = paragraphs.anchors(alone.hashes())
            mine = (first <= at) & (at < own.bounds[k + 1])
            assert at[mine].tolist() == (want + first).tolist()
            assert runs[mine].tolist() == paragraphs.run_hashes(alone.hashes(), want).tolist()
            got = parts[rows == k]
            spots = zip(*(own.places(x, rows[rows == k]).tolist() for x in (own.starts[got[:, 0]], own.ends[got[:, 1] - 1])), strict=True)
            assert sorted((s, e, b - a) for (s, e), (a, b) in zip(spots, got.tolist(), strict=True)) == sorted((s, e, len(w)) for s, e, w in _paragraphs(t.decode()))
            seen += 1
    assert seen == len(texts)


def test_short_texts_are_hashed_together_not_one_by_one(monkeypatch):
    texts = [t for t in _odd_texts(600) if len(t.split()) >= MIN]
    calls, hashes = [], paragraphs.Text.hashes
    monkeypatch.setattr(paragraphs.Text, "hashes", lambda self: calls.append(1) or hashes(self))
    sets = paragraphs.shingles([zlib.compress(t.encode(), 1) for t in texts])
    assert len(sets) == len(texts) > 300 and len(calls) < 10
    for t, own in zip(texts, sets, strict=True):
        w = [x for *_, x in _words(t)]
        assert len(own) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) and (np.diff(own.astype(object)) > 0).all()


def test_short_lines_are_in_classes_and_go_where_many_documents_hold_them(spark):
    rng = np.random.default_rng(21)
    words = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 1_000_000, k))
    lines = {n: words(MIN + 2) for n in (2, COMMON - 1, COMMON, COMMON + 3)}
    rows = [(100 * n + i, f"{words(30)}\n{line}\n{words(30)}") for n, line in lines.items() for i in range(n)]
    rows += [(5000, f"{words(20)}\n" + f"{(own := words(15))}\n" * 12)]  # one document that repeats itself is no other's boilerplate
    df = spark.createDataFrame(rows, "doc_id long, text string")
    at = {(d, t.index(lines[d // 100])) for d, t in rows if d < 5000}
    got = [r for r in paragraphs.passages(df).collect() if (r.doc_id, r.start) in at and r.n_words == MIN + 2]
    assert {(r.doc_id, r.start) for r in got} == at
    got = {(r.doc_id, r.start): r for r in sorted(got, key=lambda r: r.n_docs)}.values()  # runs of the line may be met in fewer
    assert all(r.n_docs == r.doc_id // 100 and r.keeper_doc_id == r.doc_id // 100 * 100 for r in got)
    assert all(r.removed == (r.n_docs >= COMMON and r.doc_id != r.keeper_doc_id) for r in got)
    left = dict(paragraphs.dedup(df).collect())
    for d, t in rows[:-1]:
        n, i = divmod(d, 100)
        assert left[d] == (t.replace(lines[n], "") if n >= COMMON and i else t)
    assert left[5000].startswith(rows[-1][1].split("\n")[0]) and own in left[5000]


def test_passages_are_removed_whole_and_short_ones_stay(spark):
    made = [(p, r) for size in (49, 52, 300) for p, r in _texts(60, size)]
    rows = [(1000 * n + i, t, h, e) for n, (_, two) in enumerate(made) for i, t, h, e in two]
    short = [(10**6 + i, t) for _, two in _texts(60, 30) for i, t, *_ in two]
    df = spark.createDataFrame([(i, t) for i, t, *_ in rows] + short, "doc_id long, text string")
    got = dict(paragraphs.dedup(df).collect())
    for first, second in zip(rows[::2], rows[1::2], strict=True):
        assert got[first[0]] == first[1]
        assert got[second[0]].split() == second[2] + second[3]
    assert all(got[i] == t for i, t in short)


def _wrapped(words, most, rng):
    out, at = [], 0
    while at < len(words):
        n = int(rng.integers(5, most))
        out.append(" ".join(words[at : at + n]))
        at += n
    return "\n".join(out)


def test_rewrapped_paragraphs_are_near_copies(spark):
    rng = np.random.default_rng(13)
    rows = []
    for k in range(30):  # lines of under ten words, and of up to fourteen
        words = [f"w{x}" for x in rng.integers(0, 100_000, 150)]
        near = list(words)
        for at in (40, 90):
            near[at] = "changed"
        for c, own in enumerate((words, near)):
            around = [" ".join(f"z{x}" for x in rng.integers(0, 100_000, 20)) for _ in range(2)]
            rows.append((2 * k + c, f"{around[0]}\n\n{_wrapped(own, 10 if k % 2 else 15, rng)}\n \n{around[1]}", around))
    got = dict(paragraphs.dedup(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect())
    for k, text, around in rows:
        assert got[k] == text if k % 2 == 0 else got[k].split() == " ".join(around).split()


def test_large_collision_groups_go_block_by_block(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(150):
        words = [f"w{i}" for i in range(80)]
        words[int(rng.integers(80))] = f"x{k}"
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(paragraphs, "BLOCK", 40)
    got = paragraphs.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = [(r.doc_id, r.start, r.end, r.keeper_doc_id, r.removed) for r in got if r.n_words == 80]
    assert set(_brute_paragraphs(rows)) <= set(whole) and len({w[0] for w in whole}) == 150


def test_odd_rows(spark):
    line = " ".join(f"w{k}" for k in range(60))
    near = " ".join(f"w{k}" if k != 59 else "x" for k in range(60)).upper()
    long = " ".join(f"v{k % 977}" for k in range(60_000))
    rows = [(1, f"ü\n{line}\nb"), (2, f"é\n{line}\nc"), (2, f"é\n{line}\nc"), (1, f"ü\n{line}\nb"), (3, near), (None, line), (4, None), (5, ""), (6, "short\nshort"), (7, long), (8, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.selectExpr("*", "1 as unit", "2 as h", "'x' as twin", "3 as cut_spans", "4 as keeper")
    got = paragraphs.dedup(df)
    assert got.columns == df.columns
    have = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    want = [(1, rows[0][1]), (1, ""), (2, "é\n\nc"), (2, "é\n\nc"), (3, ""), (None, ""), (4, None), (5, ""), (6, "short\nshort")]
    assert [h for h in have if h[0] not in (7, 8)] == sorted(want, key=str)
    seven, eight = (next(t for i, t in have if i == d) for d in (7, 8))
    assert eight == "" and len(seven.split()) >= 977
    assert paragraphs.passages(df.limit(0)).count() == 0 and paragraphs.dedup(df.limit(0)).count() == 0
    spans = {(r.doc_id, r.start, r.end, r.keeper_doc_id, r.removed) for r in paragraphs.passages(df.where("doc_id in (1, 3) or doc_id is null")).collect()}
    assert spans >= {(1, 2, 2 + len(line), 1, False), (1, 2, 2 + len(line), 1, True), (3, 0, len(near), 1, True), (None, 0, len(line), 1, True)}
    assert {(s[0], s[4]) for s in spans} == {(1, False), (1, True), (3, True), (None, True)}
