"""Conversation repair, archive conversion and the Merkle manifest against plain versions, and odd rows."""

import gzip
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from panelyard.llm import merkle, repair, warc

SF = "/root/testdata/sf0.01"
CHATS = "conv_id long, turn long, role string, text string"


# ---- repair ----

KEEP, NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (2, 2, 3, 2)


def _all_ways(rows):
    """The least (cost, edits) of all edits of (initial, must go, truncated) rows, two insertions in a place at most."""
    best = (float("inf"), "")

    def go(i, state, cost, edits, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and state in (0, 3):
            best = min(best, (cost, edits))
        if inserted < 2:
            go(i, NEXT[state], cost + 3, edits + "I", inserted + 1)
        if i < len(rows):
            initial, gone, cut = rows[i]
            go(i + 1, state, cost + 4, edits + "D", 0)
            if not gone:
                if initial in KEEP[state]:
                    go(i + 1, KEEP[state][initial], cost + 3 * cut, edits + "K", 0)
                go(i + 1, NEXT[state], cost + 3 + 3 * cut, edits + "R", 0)

    go(0, 0, 0, "", 0)
    return best


def _plain_search(rows):
    """The same by one whole string a state: for long conversations."""
    inf = (float("inf"), "")
    best = {0: (0, ""), 1: inf, 2: inf, 3: inf}

    def inserted(b):
        for _ in range(2):
            for q in range(4):
                b[NEXT[q]] = min(b[NEXT[q]], (b[q][0] + 3, b[q][1] + "I"))
        return b

    best = inserted(best)
    for initial, gone, cut in rows:
        new = dict.fromkeys(range(4), inf)
        for q, (cost, edits) in best.items():
            new[q] = min(new[q], (cost + 4, edits + "D"))
            if not gone:
                if initial in KEEP[q]:
                    new[KEEP[q][initial]] = min(new[KEEP[q][initial]], (cost + 3 * cut, edits + "K"))
                new[NEXT[q]] = min(new[NEXT[q]], (cost + 3 + 3 * cut, edits + "R"))
        best = inserted(new)
    return min(best[0], best[3])


def test_search_against_all_ways():
    rng = random.Random(1)
    for _ in range(400):
        rows = [(rng.choice("suuaax"), rng.random() < 0.15, rng.random() < 0.25) for _ in range(rng.randint(0, 7))]
        search = repair.Search()
        for r in rows:
            search.step(*r)
        assert search.end() == _all_ways(rows) == _plain_search(rows), rows


def test_search_of_long_conversations_and_its_open_ends():
    rng = random.Random(2)
    for initials in ("u", "a", "s", "ua", "suax", "ssssuuuuaaaa"):
        rows = [(rng.choice(initials), rng.random() < 0.1, rng.random() < 0.2) for _ in range(600)]
        search, most = repair.Search(), 0
        for r in rows:
            search.step(*r)
            most = max(most, search.open())
        assert search.end() == _plain_search(rows), initials
    search, most = repair.Search(), 0
    for i in range(5000):  # what is settled leaves the tree
        search.step("ua"[i % 2] if i % 7 else "x", i % 11 == 0, i % 5 == 0)
        most = max(most, search.open())
    assert most < 100
    search = repair.Search()
    for _ in range(3001):  # which of two users in a row begins the pairs is open to the end
        search.step("u", False, False)
    assert search.end() == _plain_search([("u", False, False)] * 3001) and search.end()[1].startswith("KIKR")


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda v: " " if v is None else str(v)
        fault, role, text = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20, one(role), one(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def _plain_op11(rows):
    found = {}
    damaged = _damage(rows)
    for conv in {r[0] for r in rows}:
        own = [r for r in damaged if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
        seen, tally, steps = set(), [0, 0, 0], []
        for _, _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                tally[fault] += 1
            steps.append((role[:1], fault in (0, 1), fault == 2))
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(steps, steps[1:], strict=False))
        cost, audit = _plain_search(steps)
        out, state, at = [], 0, iter(own)
        for e in audit:
            row = None if e == "I" else next(at)
            if e == "D":
                continue
            new = row[2] if e == "K" else {2: "user", 3: "assistant"}[NEXT[state]]
            state = KEEP[state][new[:1]] if e == "K" else NEXT[state]
            out.append(f"{new}:{row[3] if row else ''}")
        found[conv] = (gaps, *tally, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return found


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _op11(spark, rows, tmp_path):
    path = str(tmp_path)
    df = spark.createDataFrame(rows, CHATS).withColumn("digest", F.lit(1)).withColumn("audit", F.lit("x")).withColumn("fault", F.lit(9))
    df.repartition(3).write.parquet(f"{path}/conversations.parquet")
    got = repair.op11(spark, path).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got}


def test_op11_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.op11(spark, SF).collect()}
    assert got == _plain_op11(rows)


def test_op11_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    texts = ["Yes.", "No!", "", None, " \t\n", "open end", "Ah?\n ", "é.", "x" * 100_000 + ".", ".\x0b", "nul\x00.", " "]
    rows = [(rng.choice([1, 2, 3, None, -5]), turn, rng.choice(["user", "assistant", "system", None, "", "tool", "umpire", "Éa"]), rng.choice(texts)) for turn in range(-3, 120)]
    rows += [(7, None, "user", "a."), (7, None, "user", "b."), (7, 2, "user", "a."), (7, 9_000_000_000, "assistant", "z.")]
    rows += [(8, 1, "user", "Same."), (8, 1, "user", "Same."), (8, 1, "assistant", "Same.")]
    gone = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "Hello.")]
    got = _op11(spark, rows, tmp_path)
    assert got == _plain_op11(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_op11_hot_conversation_and_empty_table(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 300}.") for t in range(2000)] + [(c, 0, "user", "Hm.") for c in range(2, 100)]
    assert _op11(spark, rows, tmp_path / "hot") == _plain_op11(rows)
    assert _op11(spark, [], tmp_path / "none") == {}


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi?"), (1, 3, "user", "Hi?"), (1, 4, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, CHATS)
    found = repair.diagnose(df)
    assert [(r.duplicate, r.illegal, r.cost, r.audit) for r in found.collect()] == [(1, 2, 7, "KIKKDK")]
    got = [(r.edit, r.turn, r.role, r.text) for r in repair.repair(df, found).collect()]
    assert got == [("K", 0, "system", "Be brief."), ("I", None, "user", ""), ("K", 1, "assistant", "Hello."), ("K", 2, "user", "Hi?"), ("K", 4, "assistant", "Yes.")]


# ---- archives ----

PAGES = "page_id long, url string, html string"


def _op12(spark, rows, path):
    df = spark.createDataFrame(rows, PAGES).withColumn("id", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("key", F.lit(0))
    df.write.parquet(f"{path}/pages.parquet")
    return sorted((tuple(r) for r in warc.op12(spark, str(path)).collect()), key=str)


def test_op12_odd_rows(spark, tmp_path):
    long = "<p>" + "x" * 200
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nhttp://a 0.0.0.0 20000101000000 text/html 5\n" + "y" * 90
    rows = [(k, f"http://h/{k}", h) for k, h in enumerate([long, None, "", "short", "short", fake, long, fake, "é" * 60, "é" * 60, "z" * 99, "z" * 99, "w" * 100, "w" * 100])]
    rows += [(50, None, long), (51, "", "\r\n\r\n" + long), (52, "http://a b/\n\r\x00é?q=%20 1 2 20000101000000 t 4", "q" * 3_000_000), (-3, "http://minus", long), (60, "HTTP/1.1 x", "HTTP/1.1 200 OK\r\n\r\n" + "v" * 100)]
    got = _op12(spark, rows, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(warc.OP12_SQL).fetchall(), key=str)
    assert [r[0] for r in got if r[4] == -3] and next(r for r in got if r[0] == -3)[3] == "response"


def test_op12_null_and_repeated_ids_and_empty_table(spark, tmp_path):
    long = "n" * 150
    got = _op12(spark, [(None, "a", long), (None, "b", long), (4, "c", long), (4, "d", long), (None, "e", "m" * 150)], tmp_path / "a")
    assert sorted((r[0] is None, r[3], r[4]) for r in got) == [(False, "response", None), (False, "revisit", 4), (True, "response", None), (True, "revisit", 4), (True, "revisit", 4)]
    assert _op12(spark, [], tmp_path / "b") == []


def test_op12_hot_payload(spark, tmp_path):
    rows = [(k, f"u{k}", "h" * 120 if k % 3 == 0 else f"{k}" * 60) for k in range(3000, 0, -1)]
    got = _op12(spark, rows, tmp_path)
    assert sum(r[3] == "revisit" for r in got) == 999 and {r[4] for r in got} == {None, 3}


def test_arc_lines_of_both_versions():
    documents = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\n\nfiledesc://x 1 2 3\n", b"", b"plain", b"\n\n\n"]
    for version in (1, 2):
        made = warc.arc_head(version) + b"".join(warc.arc_record(version, f"http://h/{k} é", "20240229235959", d) for k, d in enumerate(documents))
        got = list(warc.parse_arc(made))
        assert [(r[1], r[2], r[4], r[6], r[7]) for r in got] == [(version, f"http://h/{k}%20%C3%A9", "20240229235959", d, True) for k, d in enumerate(documents)]
        assert made[got[2][0] :].startswith(b"http://h/2")
        cut = list(warc.parse_arc(made[:-3]))  # the last document loses two bytes
        assert (cut[-1][6], cut[-1][7]) == (b"\n", False)
        assert [r[6] for r in warc.parse_arc(made.replace(b"http://h/2", b"garbage line\n\nhttp://h/2"))] == documents
    blank = b"filedesc://x 0.0.0.0 20000101000000 text/plain 9\n1 0 abcd\n\nhttp://a b c 0.0.0.0 20000101000000 text/html 2\nhi\n"
    assert [(r[2], r[6]) for r in warc.parse_arc(blank)] == [("http://a b c", b"hi")]


def test_warc_records_are_whole(spark, tmp_path):
    import pyspark.sql.types as T

    rows = [(f"{k}", f"http://h/{k}", "p" * 200 if k % 2 else f"page {k}", "20200102030405", 1 + k % 2) for k in range(40)] + [("a b\né", None, "own", "19991231235959", 2)]
    kinds = T.StructType([T.StructField(n, T.StringType()) for n in ("k", "u", "p", "d")] + [T.StructField("v", T.IntegerType())])
    df = spark.createDataFrame(rows, kinds)
    warc.write_arcs(df, f"{tmp_path}/arc", F.col("k"), F.col("u"), F.col("p"), F.col("d"), F.col("v"), segment=700)
    arcs = sorted((tmp_path / "arc").glob("*.gz"))
    assert len(arcs) > 5 and {re.search(rb"\n([12]) 0 ", gzip.decompress(a.read_bytes()))[1] for a in arcs} == {b"1", b"2"}
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", "try_cast(key as long)")
    for file in (tmp_path / "warc").glob("*.gz"):
        content = gzip.decompress(file.read_bytes())
        again = b""
        for fields, block in warc.parse_warc(content):
            assert {"warc-type", "warc-record-id", "warc-date", "content-length"} <= fields.keys() and int(fields["content-length"]) == len(block)
            again += content[len(again) : content.index(block, len(again)) + len(block) + 4] if block else b""
        assert again == content and content.startswith(b"WARC/1.0\r\nWARC-Type: warcinfo")
    got = {r.key: r for r in warc.read_warcs(spark, f"{tmp_path}/warc").collect()}
    assert set(got) == {r[0] for r in rows} and all(r.intact for r in got.values()) and len({r.id for r in got.values()}) == 41
    assert got["a b\né"].url is None and got["a b\né"].date == "1999-12-31T23:59:59Z" and bytes(got["a b\né"].payload) == b"own"
    assert got["3"].refers_to_key == "1" and got["3"].refers_to_id == got["1"].id and got["3"].payload is None and got["3"].payload_bytes == 200
    assert got["1"].record_type == "response" and got["3"].payload_digest == hashlib.sha256(b"p" * 200).hexdigest()


def test_documents_without_a_head_are_resources(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "one.arc").write_bytes(warc.arc_head(1) + warc.arc_record(1, "dns:h", "20200101000000", b"h. 1 IN A 1.2.3.4", mime="text/dns"))
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    (r,) = warc.read_warcs(spark, f"{tmp_path}/warc").collect()
    assert (r.record_type, r.key, bytes(r.payload), r.intact) == ("resource", None, b"h. 1 IN A 1.2.3.4", True)


# ---- manifest ----

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(nodes):
    """(root, for each node the siblings before and after it, level by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a - a % 3 : a - a % 3 + 3]
            paths[i].append((run[: a % 3], run[a % 3 + 1 :]))
            at[i] = a // 3
        nodes = [_h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def _plain_manifest(docs):
    docs = [(d, s, g, n, t) for d, t, g, s, n in docs]
    groups = sorted({d[1] for d in docs}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(((d, _leaf(d)) for d in docs if d[1] == s), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for s in groups}
    trees = {s: _tree([leaf for _, leaf in own[s]]) for s in groups}
    root, above = _tree([trees[s][0] for s in groups]) if groups else (None, [])
    out = []
    for s, over in zip(groups, above, strict=True):
        for (d, leaf), path in zip(own[s], trees[s][1], strict=True):
            text = d[4].replace("\n", "") if d[4] is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 else d[4]
            folded = _leaf((*d[:4], text))
            for before, after in path + over:
                folded = _h(*before, folded, *after)
            out.append((d[0], leaf, trees[s][0], root, _h(*(x for p in path + over for x in (*p[0], *p[1]))), folded, folded == root))
    return sorted(out, key=str)


def _op13(spark, rows, path):
    df = spark.createDataFrame(rows, DOCS).withColumn("grp", F.lit(1)).withColumn("id", F.lit(2)).withColumn("leaf", F.lit("x")).withColumn("w", F.lit(0))
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op13(spark, str(path)).collect()), key=str)


def test_op13_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted((tuple(r) for r in merkle.op13(spark, SF).collect()), key=str) == _plain_manifest(rows)


def test_op13_odd_rows_and_several_passes(spark, tmp_path):
    rng = random.Random(4)
    big = [(k * k - 900_000, f"t{k}\n", "en", "hot", k) for k in range(1900)]  # over 729 twice; negative, sparse ids
    same = [(5, "copy\n", "en", "hot", 1)] * 800 + [(5, f"other {k}\n", "en", "hot", 1) for k in range(300)] + [(None, f"none {k}", None, "hot", None) for k in range(40)]
    odd = [(None, None, None, None, None), (None, None, None, None, None), (-(1 << 63), "", "", "", 0), ((1 << 63) - 1, "é\n\n", "é", "é", -1), (0, "a\nb", "x", "\U0001f600", 2), (63, "x", "y", "￿", 3), (64, "x", "y", "￿", 3), (127, "1:2-", "y", "￿", 3), (1, "z" * 300_000 + "\n", "en", "one", 9)]
    rows = big + same + odd + [(k, "w\n", "en", f"s{k % 5}", k) for k in range(30)]
    rng.shuffle(rows)
    assert _op13(spark, rows, tmp_path / "a") == _plain_manifest(rows)
    assert _op13(spark, [], tmp_path / "b") == []
    single = [(3, "only\n", "en", "s", 1)]
    assert _op13(spark, single, tmp_path / "c") == _plain_manifest(single)


def test_manifest_of_many_groups(spark):
    rows = [(k, f"g{k % 900}") for k in range(2000)]
    df = spark.createDataFrame(rows, "k long, g string")
    got = merkle.manifest(df, "k", "g", ["k", "g"]).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(got) == 2000 and {r.folded == r.root for r in got} == {True} and len({r.root for r in got}) == 1
    trees = [_tree([_leaf(r) for r in rows if r[1] == g])[0] for g in sorted({r[1] for r in rows})]
    assert got[0].root == _tree(trees)[0] and {r.subroot for r in got} == set(trees)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 728, 729, 730])
def test_shapes(spark, n):
    nodes = spark.range(n).select(F.lit("g").alias("grp"), F.col("id").alias("place"), F.lit(1).alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.lit(n).alias("size"))
    passes = merkle.ascend(nodes, [])
    assert passes[-1].first().top == _tree([_h(str(k)) for k in range(n)])[0]
