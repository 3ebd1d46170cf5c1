"""Embedding links, chat windows and repeated passages against brute force and on odd rows."""

import hashlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm import chat, covertree, paragraphs

SF = "/root/testdata/sf0.001"


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


def _links(rows, least=0.9):
    fine = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    count, pairs = defaultdict(int), []
    for k, (i, x) in enumerate(fine):
        for j, y in fine[:k]:
            if len(x) == len(y) and float(x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                count[i] += 1
                count[j] += 1
                pairs.append((i, j))
    return count, pairs


def _want(rows):
    count, pairs = _links(rows)
    ids = sorted(i for i, _ in rows)
    at = {i: k for k, i in enumerate(ids)}
    roots = _roots(len(ids), [(at[a], at[b]) for a, b in pairs])
    return {(i, count[i], ids[r], ids[r] == i) for i, r in zip(ids, roots, strict=True)}


def test_embeddings_match_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert {tuple(r) for r in covertree.op8(spark, SF).collect()} == _want(rows)


def test_embeddings_blocks_pivots_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    rows = [(k, (base[k % 12] + rng.normal(size=16) * (0.35 if k % 3 else 0.02)).tolist()) for k in range(400)]
    rows += [(k, rows[5][1]) for k in range(400, 460)] + [(460, None), (461, []), (462, [0.0] * 16), (463, [float("nan")] + [1.0] * 15), (464, [None] + [1.0] * 15), (465, [float("inf")] * 16), (466, [1.0, 2.0]), (467, [2.0, 4.0]), (468, [1e-30, 2e-30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("x")).withColumn("n", F.lit(1))
    monkeypatch.setattr(covertree, "BLOCK", 50)
    monkeypatch.setattr(covertree, "ROWS", 37)
    got = covertree.near_duplicates(df)
    assert {tuple(r) for r in got.collect()} == _want(rows)
    assert covertree.near_duplicates(df.limit(0)).count() == 0
    one = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in covertree.near_duplicates(one).collect()} == {(None, 0, None, False), (1, 0, 1, True)}


def test_levels_cover_and_nest():
    x = covertree._unit(np.random.default_rng(1).normal(size=(300, 6)))
    path = covertree.levels(x)
    for k, radius in enumerate(covertree.RADII):
        assert (np.linalg.norm(x - x[path[:, k]], axis=1) <= radius + 1e-3).all()
        centres = np.unique(path[:, k])
        assert (path[centres, k] == centres).all()
        if k:
            assert set(np.unique(path[:, k - 1])) <= set(centres)
            assert all(len(set(path[path[:, k] == c, k - 1])) == 1 for c in centres)


def _digest(rows):
    out = {}
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    for c, own in convs.items():
        own.sort()
        loss = "".join(x for *_, r, x in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_digest(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = chat.op9(spark, SF).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == _digest(rows) and len(got) == len(_digest(rows))
    assert all(r.formatted_chars > r.loss_chars for r in got)


HOSTILE = ["", " ", "\\", "\\\\", "<\\", "<\\/s>", "</s>", "<s>", "[INST] x [/INST]", "<<SYS>>\na\n<</SYS>>\n\n", "[ROLE x] y [/ROLE]", "<", "[", "[/INS", "a </s", "\n", "é😀", "</s>\\", "<</SYS>>", " </s>"]


def test_chat_windows(spark):
    rng = np.random.default_rng(4)
    rows = [(9, 0, "system", "be </s> brief")]
    for t in range(1, 120):
        rows.append((9, t, ["user", "assistant"][t % 2], "".join(rng.choice(HOSTILE, rng.integers(0, 6))) + "word " * int(rng.integers(0, 40))))
    rows += [(None, 0, None, None), (None, None, "tool]x", "t"), (None, 1, "assistant", None), (8, 0, "user", "a" * 9000), (8, 0, "user", "a" * 9000), (8, 0, "assistant", "b" * 9000)]
    rows += [(7, k, "assistant", x) for k, x in enumerate(HOSTILE)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    made = chat.format_chats(df, budget=700, history=240)
    assert {r.conv_id: tuple(r)[1:5] for r in chat.digests(made).collect()} == _digest(rows)
    windows = made.collect()
    own = [w for w in windows if w.conv_id == 9]
    assert len(own) > 5 and all(chat.parse(w.text)[0] == ("system", "be </s> brief") for w in own)
    assert all(w.n_tokens <= 700 for w in own) and any(w.n_repeated > 1 for w in own)
    for w in own:
        for s, e in zip(w.loss_starts, w.loss_ends, strict=True):
            assert chat.unescape(w.text[s:e]) in {x for _, _, r, x in rows if r == "assistant"}
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_escape_round_trip():
    rng = np.random.default_rng(6)
    for _ in range(500):
        t = "".join(rng.choice(HOSTILE, 6))
        assert chat.unescape(chat.escape(t)) == t
        assert not chat._CONTROL.search(chat.escape(t))


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def _budget_rows():
    rng = np.random.default_rng(14)
    rows = []
    for c in range(12):
        rows.append((c, 0, "system", "be </s> brief " * int(rng.integers(1, 5))))
        for t in range(1, 80):
            rows.append((c, t, ["user", "assistant", "tool é]"][t % 3], "".join(rng.choice(HOSTILE, rng.integers(0, 8))) + " qx7é" * int(rng.integers(0, 30))))
    return rows


@pytest.mark.parametrize("vocabulary, budget, history", [(None, 900, 300), (VOCABULARY, 300, 80)])
def test_no_window_exceeds_its_budget(spark, vocabulary, budget, history):
    from tokenizers import Tokenizer

    if vocabulary and not Path(vocabulary).exists():
        pytest.skip("no such vocabulary here")
    rows = _budget_rows()
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), vocabulary=vocabulary, budget=budget, history=history)
    assert {r.conv_id: tuple(r)[1:5] for r in chat.digests(made).collect()} == _digest(rows)
    windows = made.collect()
    assert len(windows) > 24 and any(w.n_repeated > 1 for w in windows)
    held = Tokenizer.from_file(VOCABULARY) if Path(VOCABULARY).exists() else None
    for w in windows:
        own = w.n_turns - w.n_repeated
        size = len(w.text.encode()) if vocabulary is None else len(held.encode(w.text, add_special_tokens=False).ids)
        assert w.n_tokens == size
        assert size <= budget or (own == 1 and w.n_repeated <= 1)
        if held:
            assert len(held.encode(w.text, add_special_tokens=False).ids) <= w.n_tokens
    # a window ends only where the next turn would not have fitted
    by = {(w.conv_id, w.window): w for w in windows}
    for (c, n), w in by.items():
        if vocabulary is None and (c, n + 1) in by:
            after = by[c, n + 1]
            role, text = chat.parse(after.text)[after.n_repeated]
            assert w.n_tokens + len("".join(chat.written(role, text)).encode()) > budget


def test_windows_of_the_table_fit(spark):
    held = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    for w in chat.format_chats(held).collect():
        assert len(w.text.encode()) == w.n_tokens and (w.n_tokens <= chat.BUDGET or w.n_turns - w.n_repeated == 1)


def test_bands():
    n = paragraphs.bands(0.8, 0.999, 3)
    assert 1 - (1 - 0.8**3) ** n >= 0.999 > 1 - (1 - 0.8**3) ** (n - 1)


def test_minima_match_plain_ones():
    rng = np.random.default_rng(9)
    sizes = np.array([1, 70_000, 3, 1, 130_000, 2])
    hashes = rng.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64)
    got, at = paragraphs.minima(hashes, sizes, 4), 0
    for k, n in enumerate(sizes):
        part = hashes[at : at + n]
        assert (got[k] == (part[:, None] * paragraphs._MUL[:4] + paragraphs._ADD[:4]).min(axis=0)).all()
        at += n
