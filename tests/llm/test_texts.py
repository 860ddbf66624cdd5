"""Operators on texts against plain versions: encoding, files, decontamination, rules, chat, pseudonyms."""

import datetime
import hashlib
import itertools
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgrade.llm import bpe, chat, common, decontaminate, line_rules, pii, tokenfile

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n", "a", "it's they'll 'S é's", "a <|endoftext|>b<|endoftext|>", "x  y\t z\n\n", "é ñ ü ß ×3 a÷b", "aaaaaaaaaaaa", "😀 中文 ١٢٣ é ́x",
    "12ab34,5.6%", " x  y", "a\x1cb", "word " * 3000, "q" * 5000, "<|endoftext|>", "a<|b|> c", "Ünï\nßcö\r\nz",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_encoding_equals_the_library(spark):
    lib = Tokenizer.from_file(BYTE)
    out = {r["doc_id"]: r for r in bpe.encode_decode(frame(spark, ODD), BYTE, ids=True).collect()}
    for i, t in enumerate(ODD):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert out[i]["ids"] == ids and out[i]["n_tokens"] == len(ids), t
        assert out[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert out[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abc AB'\n.,12%é×<|>"), st.characters(codec="utf-8")), max_size=40), max_size=6))
def test_encoding_equals_the_library_on_any_text(texts):
    lib, own = Tokenizer.from_file(BYTE), bpe.load(BYTE)
    flat, counts = own.encode([t.encode() for t in texts]) if texts else (np.zeros(0, int), np.zeros(0, int))
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


def test_encoding_keeps_other_columns(spark):
    out = bpe.encode_table(frame(spark, ODD), BYTE)
    assert out.columns == ["doc_id", "text", "n_tokens", "_n_tokens", "ids"]
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == [t or "" for t in ODD]
    assert bpe.encode_table(frame(spark, ODD).limit(0), BYTE).count() == 0


def test_token_files(spark):
    lib = Tokenizer.from_file(WORD)
    docs = frame(spark, ODD).unionByName(frame(spark, ["again"]).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(frame(spark, ["x y"]).withColumn("doc_id", F.lit(3).cast("long")))
    out = common.scratch(spark, "test-tokens")
    manifest = tokenfile.write_tokens(docs, WORD, out, 2)
    rows = tokenfile.read_tokens(spark, out, manifest).collect()
    rows.sort(key=lambda r: r["start"])
    assert [r["key"] for r in rows] == [None, 0, 1, 2, 3, 3, *range(4, len(ODD))]
    at = 0
    texts = {i: t for i, t in enumerate(ODD)}
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
        if r["key"] not in (None, 3):
            ids = lib.encode(texts[r["key"]] or "", add_special_tokens=False).ids + [2]
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    m = [x for x in manifest.orderBy("place").collect()]
    got = {}
    for x in m:
        got |= tokenfile.open_reader(f"{out}/{x['file']}").documents({4, 14})
    assert {k: v.tolist() for k, v in got.items()} == {k: lib.encode(ODD[k], add_special_tokens=False).ids + [2] for k in (4, 14)}
    assert tokenfile.write_and_read(docs.limit(0), WORD, 2).count() == 0


def test_damaged_frames_are_found(tmp_path):
    path = tmp_path / "a.tok"
    with open(path, "wb") as f:
        w = tokenfile.Writer(f)
        for i in range(3000):
            w.add(i, np.arange(i, i + 50, dtype=np.int32))
        w.close()
    odd = tmp_path / "odd.tok"
    with open(odd, "wb") as f:
        w = tokenfile.Writer(f)
        for k in (None, -(1 << 63), 0, (1 << 63) - 1):
            w.add(k, np.array([7]))
        w.close()
    back = tokenfile.open_reader(f"file://{odd}")
    assert [(k, s) for k, s, _ in back.frame_documents(0)] == [(None, 0), (-(1 << 63), 1), (0, 2), ((1 << 63) - 1, 3)] and list(back.documents({0, -(1 << 63)})) == [-(1 << 63), 0]
    assert tokenfile.file_system("s3a://bucket/a?region=eu-west-1")[0].type_name == "s3"
    reader = tokenfile.open_reader(f"file://{path}")
    assert len(reader.frame_docs) > 1 and reader.documents({2999})[2999].tolist() == list(range(2999, 3049))
    raw = bytearray(path.read_bytes())
    reader.sums[0] ^= 1
    with pytest.raises(ValueError):
        reader.frame(0)
    assert raw[-4:] == (0x8F92EAB1).to_bytes(4, "little")


def brute_contamination(docs, items):
    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for k, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    out = {}
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    own |= windows[x]
        out[d] = (len(w), len(hit), sorted(own), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and runs far away from here today"), (2, "Short item"), (3, ""), (4, None), (10, "é one two three four five six seven eight nine ten eleven twelve thirteen"), (2, "other words")]
DOCS = [
    (0, "x THE quick, brown fox jumps over the lazy dog and runs far away from y"), (1, "short   item and short item"), (2, None), (3, ""), (4, "the quick brown fox " * 50), (5, "pad " * 400 + ITEMS[0][1] + " pad" * 400),
    (6, "É one two three four five six seven eight nine ten eleven twelve thirteen é one"), (7, "other words short item"), (8, "the quick brown red fox jumps over the lazy dog and runs far away from"),
]


@pytest.mark.parametrize("block_bytes", [10**6, 40])
def test_contamination(spark, block_bytes):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in decontaminate.contamination(docs, items, block_bytes=block_bytes).collect()}
    assert got == brute_contamination(DOCS, ITEMS)
    assert decontaminate.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    kept = decontaminate.decontaminate(docs.withColumn("bad_key", F.lit(1)), items)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if not v[3]} and kept.columns == ["doc_id", "text", "bad_key"]


def test_proximity(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    exact = {r["doc_id"] for r in decontaminate.contamination(docs, items).where("n_hit > 0").collect()}
    near = {r["doc_id"] for r in decontaminate.contamination(docs, items, slop=1).where("n_hit > 0").collect()}
    assert near == exact | {8}


@pytest.mark.parametrize("shard_bytes, block_bytes", [(50, 8_000_000), (4_000_000, 60)])
def test_contamination_of_repeated_rows_and_long_texts(spark, monkeypatch, shard_bytes, block_bytes):
    """Repeated documents keep their rows over several blocks; matches end at a document's end; a text beyond a shard's size is whole."""
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard_bytes)
    phrase = " ".join(f"p{i}" for i in range(13))
    items = [("a", phrase), ("a", phrase), ("b", "tail one two"), (None, "lonely"), ("c", None), ("d", "split " + "here " * 12)]
    texts = [phrase, phrase, "p0 p1 p2 p3 p4 p5", "p6 p7 p8 p9 p10 p11 p12", "x " * 40_000 + phrase + " x" * 40_000, None, "", "say tail one", "two lonely", "split", "here " * 12]
    rows = [(i // 2 if i < 2 else i, t, "clash") for i, t in enumerate(texts)] + [(None, phrase, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string").coalesce(1)
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id string, text string"), block_bytes=block_bytes).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in found)
    want = [("0", 13, 13, "a", True)] * 2 + [("2", 6, 0, "", False), ("3", 7, 0, "", False), ("4", 80_013, 13, "a", False), ("5", 0, 0, "", False), ("6", 0, 0, "", False)]
    want += [("7", 3, 0, "", False), ("8", 2, 1, "null", True), ("9", 1, 0, "", False), ("10", 12, 0, "", False), ("None", 13, 13, "a", True)]
    assert got == sorted(want)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    left = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id string, text string"))
    assert left.count() == len(rows) - 4 and left.columns == docs.columns
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame(items, "item_id string, text string")).count() == 0


def test_one_index_serves_several_test_sets(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "three four five"), (3, "six")], "doc_id long, text string")
    index = common.materialise(decontaminate.build_index(docs), "index")
    search = lambda items: {r["key"]: list(r["items"]) for r in decontaminate.search_index(index, spark.sparkContext.broadcast(decontaminate.TestSet(items))).collect()}
    assert search([("a", "three four"), ("b", "six")]) == {1: ["a"], 2: ["a"], 3: ["b"]}
    assert search([("c", "four five"), ("d", "unseen")]) == {1: [], 2: ["c"], 3: []}


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(zip(w, w[1:], w[2:]))
    hit = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for j in range(3)}
    lines = t.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t|#!.😀", max_size=60), min_size=1, max_size=5))
def test_line_counts(texts):
    x = line_rules.Lines([t.encode() for t in texts])
    got = list(zip(*(getattr(x, c).tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [brute_counts(t) for t in texts]


def test_viterbi_and_gradient():
    rng = np.random.default_rng(1)
    lines = np.array([3, 0, 1, 5])
    features = (rng.random((9, line_rules.N_FEATURES)) < 0.4).astype(float)
    field = line_rules.LineField()
    field.emit, field.move = rng.standard_normal(field.emit.shape), rng.standard_normal((2, 2))
    marks = field.decode(features, lines)
    e = features @ field.emit
    for a, n in zip(np.cumsum(lines) - lines, lines):
        value = lambda y: sum(e[a + i, y[i]] for i in range(n)) + sum(field.move[y[i], y[i + 1]] for i in range(n - 1))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=n), key=value) if n else ()
        assert tuple(marks[a : a + n]) == best
    gold = rng.integers(0, 2, 9)
    field = line_rules.LineField()
    field.train(features, gold, lines, steps=300)
    assert (field.decode(features, lines) == gold).mean() > 0.85


def rule_corpus():
    """Good texts with a common footer and noise lines, bad texts with a few plain lines."""
    r = np.random.default_rng(6)
    plain = lambda: " ".join("w%d" % x for x in r.integers(0, 3000, 14)) + "."
    noise = lambda: " ".join("W%d###" % x for x in r.integers(0, 3000, 14))
    rows, labels, kinds = [], [], {}
    for i in range(120):
        good = i % 4 != 0
        own = [(noise() if r.random() < (0.15 if good else 0.85) else plain()) for _ in range(12)]
        if good:
            own.insert(6, "Printed by the same press, all rights kept.")
        kinds[i] = own
        rows.append((i, "\n".join(own)))
        labels.append((i, int(good)))
    return rows, labels, kinds


def test_lines_of_one_text_get_labels_of_both_kinds(spark):
    rows, labels, kinds = rule_corpus()
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, kept double")
    field = line_rules.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    hits = total = mixed = 0
    for i, own in kinds.items():
        x = line_rules.Lines([rows[i][1].encode()])
        marks = field.decode(field.observed(x.features, x.line_keys), x.lines)
        truth = ["###" not in t and not t.startswith("Printed") for t in own]
        hits += sum(int(a) == int(b) for a, b in zip(marks, truth))
        total += len(own)
        mixed += 0 < marks.sum() < len(marks)
    assert hits / total > 0.95 and mixed > 80
    # the verdict, line by line in plain steps
    got = {r["doc_id"]: r for r in line_rules.judge(docs, field).collect()}
    for i, t in rows:
        x = line_rules.Lines([t.encode()])
        e = field.observed(x.features, x.line_keys) @ field.emit
        best = [([m], e[0, m]) for m in (0, 1)]
        for k in range(1, len(e)):
            best = [max(((path + [m], v + field.move[path[-1], m] + e[k, m]) for path, v in best), key=lambda b: b[1]) for m in (0, 1)]
        path = max(best, key=lambda b: b[1])[0]
        chars = [sum(len(w) for w in line.split()) for line in t.split("\n")]
        share = sum(c for c, m in zip(chars, path) if m) / sum(chars)
        n, *_, repeats = brute_counts(t)
        assert abs(got[i]["content_share"] - share) < 1e-9 and got[i]["n_content_lines"] == sum(path)
        assert got[i]["kept"] == (share >= 0.5 and not (n < 50 or 100 * repeats > 50 * n))


def test_documents_hold_the_labels_of_their_lines():
    r = np.random.default_rng(2)
    for _ in range(200):
        lines = r.integers(0, 7, 4)
        n = int(lines.sum())
        marks, fixed, chars, content, good = r.integers(0, 2, n), r.random(n) < 0.3, r.integers(1, 30, n), r.random(n), r.integers(0, 2, 4)
        out = line_rules.constrained(marks, content, fixed, chars, lines, good)
        at = 0
        for k, g in zip(lines, good):
            own = slice(at, at + k)
            at += k
            assert (out[own][fixed[own]] == marks[own][fixed[own]]).all()
            met = (chars[own][out[own] == 1].sum() >= 0.5 * chars[own].sum()) == bool(g)
            free = ~fixed[own] & (marks[own] != g)
            assert met or (out[own][free] == g).all()  # else nothing is left to change
            changed = out[own] != marks[own]
            assert not changed.any() or max(abs(content[own][changed] - g)) <= min([*abs(content[own][free & ~changed] - g), 1])


def test_rules_on_odd_rows(spark):
    texts = [None, "", "word " * 20, "a b c " * 40, " ".join(f"w{i}" for i in range(80)), "x y z\n" * 200_000]
    docs = frame(spark, texts).withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(4, 1), (None, 1), (2, None), (4, 1), (5, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in line_rules.quality_rules(docs.union(docs), labels).collect()}
    assert [got[i]["base_failed"] for i in range(6)] == [True, True, True, True, False, True] and got[4]["kept"] and not got[0]["kept"]
    assert got[5]["n_lines"] == 200_000 and got[5]["n_dup_lines"] == 199_999
    assert line_rules.quality_rules(docs, labels.limit(0)).where("doc_id = 4").first()["kept"]
    assert line_rules.quality_rules(docs.limit(0), labels).count() == 0


TRICKY = [r"\### Assistant: </turn> ok", "", None, "<turn>a</turn><turn>b", "#### \\h \\b \\\\", "😀 ###### : user: ", "\n### user: <turn>"]


def test_chat_reads_back(spark):
    rows = [(c, t, r, x) for c, (t, (r, x)) in enumerate(enumerate(itertools.product(["user", "assistant", "a:b", None], TRICKY)))]
    rows = [(c % 3 if c % 7 else None, c // 2, r, x) for c, _, r, x in rows]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    made = chat.format_chats(df)
    got = {r["conv_id"]: r for r in made.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.learned(F.col("formatted"), F.col("loss_mask")).alias("loss"), "formatted").collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(x["role"], x["text"]) for x in got[conv]["turns"]] == [(r, x) for _, r, x in own]
        assert got[conv]["loss"] == [x for _, r, x in own if r == "assistant"]
        runs = [k for k, _ in itertools.groupby(own, key=lambda o: o[1])]
        assert got[conv]["formatted"].count("### ") == len(runs)
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


def test_chat_of_many_and_of_equal_turns(spark):
    rows = [(1, i // 3, "user" if i % 4 else "assistant", f"t{i % 5} ###") for i in range(9000)] + [(2, 0, "assistant", "same")] * 3 + [(3, None, "assistant", "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).select("conv_id", "formatted", chat.learned(F.col("formatted"), F.col("loss_mask")).alias("loss"), F.size(chat.parse(F.col("formatted"))).alias("n")).collect()}
    for conv in (1, 2, 3):
        own = sorted(((t if t is not None else -1, r, x) for c, t, r, x in rows if c == conv))
        assert got[conv]["n"] == len(own) and got[conv]["loss"] == [x for _, r, x in own if r == "assistant"]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms_keep_their_format(spark):
    body = [f"4{i:014d}" for i in range(150)]
    cards = [b + next(c for c in "0123456789" if luhn(b + c)) for b in body]
    texts = {"card": cards, "ip": [f"10.{i}.0.{255 - i}" for i in range(150)], "date": [f"20{i % 100:02d}-0{1 + i % 9}-1{i % 10}" for i in range(100)], "phone": [f"+1 (2{i:02d}) 555-01{i:02d}" for i in range(100)], "email": [f"Jo.{i}x@mail.example.com" for i in range(100)], "secret": [f"{i:040x}" for i in range(100)], "social": [f"1{i:02d}-45-6789" for i in range(100)]}
    rows = [(k, v) for k, vs in texts.items() for v in dict.fromkeys(vs)]
    df = spark.createDataFrame([(i, f"see {v}, and {v}.", 1, 2) for i, (_, v) in enumerate(rows)], "doc_id long, text string, found int, rebuilt int")
    got = pii.pseudonymise(df, "key", counts="kinds").orderBy("doc_id").collect()
    seen = {}
    for (kind, v), r in zip(rows, got):
        m = re.fullmatch(r"see (.*), and (.*)\.", r["text"])
        new = m[1]
        assert m[1] == m[2] and r["kinds"] == [kind, kind] and regex.fullmatch(pii.PATTERNS[kind], new), (kind, v, new)
        assert len(new) == len(v) or kind == "ip"
        assert seen.setdefault((kind, new), v) == v
        if kind == "card":
            assert luhn(new) and new[0] == v[0]
        if kind == "date":
            datetime.date.fromisoformat(new)
    assert sum(v == n for (k, n), v in seen.items()) <= 2


def test_values_beside_numbers_are_found(spark):
    beside = {
        "4111 1111 1111 1111 123": "4111 1111 1111 1111", "4111111111111111 12/25": "4111111111111111", "12345 4111 1111 1111 1111": "4111 1111 1111 1111", "99-4111-1111-1111-1111": "4111-1111-1111-1111",
        "2019 123-45-6789": "123-45-6789", "10023 555-123-4567": "555-123-4567", "7 4111111111111111 5 123-45-6789 8": "123-45-6789", "4111111111111112 4111111111111111": " 4111111111111111", "1 " * 6000 + "123-45-6789": "123-45-6789",
    }
    df = spark.createDataFrame(list(enumerate(beside)), "doc_id long, text string")
    got = [r["text"] for r in pii.pseudonymise(df, "key").orderBy("doc_id").collect()]
    assert all(len(g) == len(t) and v not in g for g, (t, v) in zip(got, beside.items())), got
    assert got[1].endswith(" 12/25") and got[4].startswith("2019 ") and got[5].startswith("10023 ")


def plain_feistel(a, b, m, n, tweak, key="key"):
    for i in range(1, pii.ROUNDS + 1):
        number = lambda half: int(hashlib.sha256("|".join([key, tweak, str(i), str(half)]).encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        a, b = ((a + number(b)) % m, b) if i % 2 else (a, (b + number(a)) % n)
    return a, b


def plain_digits(d, kind):
    u = len(d) // 2
    a, b = plain_feistel(int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u), f"{kind}{len(d)}")
    return f"{a:0{u}d}{b:0{len(d) - u}d}"


def plain_places(values, bases, shape):
    h = len(values) // 2
    x, y, r, q = values[:h], values[h:], bases[:h], bases[h:]
    for i in range(1, pii.ROUNDS + 1):
        told = hashlib.sha512("|".join(["key", shape, str(i), ",".join(map(str, y))]).encode()).hexdigest()
        x, y = y, [(v + int(told[j % 32 * 4 : j % 32 * 4 + 4], 16)) % r[j] for j, v in enumerate(x)]
        r, q = q, r
    return x + y


def plain_pseudonym(kind, v):
    digits = "".join(c for c in v if c.isdigit())
    put = lambda new: (lambda it: "".join(next(it) if c.isdigit() else c for c in v))(iter(new))
    if kind == "card":
        body = digits[0] + plain_digits(digits[1:-1], "card")
        return put(body + next(c for c in "0123456789" if luhn(body + c)))
    if kind == "phone":
        return put(digits[:-10] + plain_digits(digits[-10:], "phone"))
    if kind == "social":
        areas = [x for x in range(1, 900) if x != 666]
        a, b = plain_feistel(areas.index(int(v[:3])) * 99 + int(v[4:6]) - 1, int(v[7:]) - 1, 898 * 99, 9999, "social")
        return f"{areas[a // 99]:03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    if kind == "ip":
        o = [int(x) for x in v.split(".")]
        a, b = plain_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "date":
        first = datetime.date(1800, 1, 1)
        a, b = plain_feistel(*divmod((datetime.date.fromisoformat(v) - first).days, 773), 189, 773, "date")
        return (first + datetime.timedelta(a * 773 + b)).isoformat()
    if kind == "secret":
        new = plain_places([int(c, 16) for c in v], [16] * len(v), f"secret{len(v)}")
        told = "".join("%x" % x for x in new)
        return told.upper() if any(c.isupper() for c in v) and not any(c.islower() for c in v) else told
    local, _, domain = v.partition("@")
    kinds = [("0123456789", "0"), ("abcdefghijklmnopqrstuvwxyz", "a"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A")]
    of = [next((k for k in kinds if c in k[0]), (c, c)) for c in local]
    new = plain_places([k[0].index(c) for c, k in zip(local, of)], [len(k[0]) for k in of], "email" + "".join(k[1] for k in of))
    return "".join(k[0][x] for k, x in zip(of, new)) + "@" + domain


def test_pseudonyms_equal_a_plain_feistel(spark):
    r = np.random.default_rng(3)
    values = [("social", f"{a:03d}-{g:02d}-{n:04d}") for a, g, n in [(1, 1, 1), (665, 99, 9999), (667, 5, 5), (899, 99, 9999), *zip(r.integers(1, 600, 20), r.integers(1, 100, 20), r.integers(1, 10000, 20))]]
    values += [("phone", "+1 (132) 555-1352"), ("phone", "555-123-4567"), ("ip", "10.0.255.7"), ("ip", "255.255.255.255"), ("date", "1800-01-01"), ("date", "2199-12-31"), ("date", "2024-02-29")]
    values += [("card", "4111 1111 1111 1111"), ("card", "4929348385146306"), ("email", "oscin.97@mail6.example.com"), ("email", "A.bc+D-9@x.org"), ("email", "q@x.org")]
    values += [("secret", s) for s in ("9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "abcdef" * 6, "ABCDEF" * 6, "aBCDEF" * 6, "F" * 33)]
    rows = [(i, f"see {v} there") for i, (_, v) in enumerate(values)] * 2  # repeated rows stay repeated
    out = pii.pseudonymise(spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, kinds string"), "key", counts="kinds").orderBy("doc_id").collect()
    got = {x["doc_id"]: (x["kinds"], x["text"][4:-6]) for x in out}
    assert len(out) == len(rows)
    assert got == {i: ([k], plain_pseudonym(k, v)) for i, (k, v) in enumerate(values)}
    new = [g[1] for g in got.values()]
    assert all(pii_social(v) for (k, _), v in zip(values, new) if k == "social")
    by = {v: n for (_, v), n in zip(values, new)}
    assert by["abcdef" * 6] == by["aBCDEF" * 6] == by["ABCDEF" * 6].lower() and by["ABCDEF" * 6].isupper()


def pii_social(v):
    return re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", v) is not None


def test_a_long_text_of_many_candidates(spark):
    text = " ".join(f"user{i}@mail.org and 10.0.{i % 250}.{i % 9} or {i}" for i in range(5000))
    got = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "key", counts="n").first()
    assert len(got["n"]) == 10_000 and len(got["text"].split()) == len(text.split())


def test_pseudonyms_leave_others_alone(spark):
    plain = [None, "", "Version 2.0, CC BY-NC 4.0", "4111111111111112", "999.1.1.1", "1.2.3.4.5", "2021-02-30", "000-12-1234", "a@b", "x" * 5000, "1" * 25, "123e4567"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(plain)], "doc_id long, text string")
    out = pii.pseudonymise(df, "key")
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == plain and out.columns == df.columns
    assert "Python" not in out._jdf.queryExecution().toString() and pii.pseudonymise(df.limit(0), "key").count() == 0


def test_large_folder_is_free_of_local_files(spark):
    assert os.path.isabs(common.shared_dir(spark).removeprefix("file://"))
