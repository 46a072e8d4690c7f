"""Training-data operators against brute force, with nulls, repeats, ties, empty tables and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import tempfile
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from itemlake.llm import bpe, chat, jaccard, mixing, pii, pretokens, quality, registry, substring, tokenfile, vectors, warc
from itemlake.plans.scratch import materialise, new_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, links long, cluster long, rank long, at long, n long"


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["the", "an", "re", "io", "ç", "st"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows() -> list[tuple[int | None, str | None]]:
    a, b, c = prose(1, 200), prose(2, 150), prose(3, 60)
    near = list(a)
    near[100] = "edited"
    passage = c + prose(5, 40)
    out = [
        (10, " ".join(a)), (4, " ".join(a)), (11, "\n".join(near)), (12, " ".join(prose(4, 30) + c)), (13, " ".join(passage)), (14, " ".join(b)), (14, " ".join(b)),
        (20, None), (21, ""), (22, " \n\t "), (23, "one"), (24, "one two"), (25, "one  two"), (None, " ".join(a)), (None, None), (30, "x " * 300), (31, "x " * 299),
        (32, "a b \x1f c d " * 40), (33, "mail a.b@c.de, 10.0.0.1 and +1 (456) 555-2186; 4111 1111 1111 1111 <|endoftext|> it's" + " " * 5), (3, " ".join(a[:120])),
    ]
    return out + [(100 + i, " ".join(prose(50 + i, 70 + i))) for i in range(20)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i == 23 else f"s{(i or 0) % 3}", len(t or ""), -1, -2, -3, -4, -5, -6) for i, t in rows], SCHEMA).repartition(3).cache()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


# --- 1


def test_warc(spark):
    pages = [(1, "u", "<p>é"), (2, "v\r\nx: y", "<p>é"), (3, None, None), (4, "w", ""), (5, "w", "z" * 200_000), (5, "w", "z" * 200_000), (None, "n", "solo"), (6, "k", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = new_folder(spark, "warc")
    warc.write_warc(df, folder)
    for size in (64 << 20, 97):
        got = sorted(warc.page_digests(warc.read_warc(spark, folder, size)).collect(), key=str)
        assert len(got) == len(pages)
        for r in got:
            raw = next(h or "" for i, _, h in pages if i == r.page_id).encode()
            assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            assert (r.record_type, r.refers_to) == {1: ("revisit", 2), 3: ("revisit", 4)}.get(r.page_id, ("response", None))
    empty = new_folder(spark, "warc")
    warc.write_warc(df.filter("false"), empty)
    assert warc.write_warc(df.filter("page_id = 1"), new_folder(spark, "warc")).first().records == 1


def test_warc_reader_refuses_members_inside_a_payload(tmp_path):
    def member(payload: bytes, name: str, level: int) -> bytes:
        head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{name}>\r\nContent-Type: text/plain\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
        return pack.compress(head + payload + b"\r\n\r\n") + pack.flush()

    inner = member(b"inner" * 30, "in1", 6) + member(b"second", "in2", 6)
    raw = b"".join([member(b"first" * 50, "a", 6), member(b"pad" * 9 + inner + b"tail" * 20, "b", 0), member(b"last", "c", 6)])
    path = tmp_path / "x.warc.gz"
    path.write_bytes(raw)
    for size in (len(raw), 150, 61, 17):
        got, past = [], 0
        for start in range(0, len(raw), size):
            end = min(len(raw), start + size)
            chain = warc.chain_in_range(str(path), len(raw), start, end)
            if chain and chain[0] >= past:
                got += [r["record_id"] for r in warc.records_from(str(path), len(raw), chain[0], end)]
            past = max(past, chain[1] if chain else 0)
        assert got == ["a", "b", "c"]


def test_warc_reader_tells_damage_in_every_range_size(spark):
    r = random.Random(3)
    pages = [(i, f"u{i}", "".join(r.choice("abcdefgh <>") for _ in range(400))) for i in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    folder = new_folder(spark, "warc")
    warc.write_warc(df, folder)
    whole = Path(next(Path(folder.removeprefix("file://")).glob("*.warc.gz"))).read_bytes()
    broken = {"cut": whole[:-9], "head": b"x" + whole[1:], "hit": whole[: len(whole) // 2] + bytes(20) + whole[len(whole) // 2 + 20 :], "more": whole + b"\0" * 5}
    for size in (17, 1000, len(whole), 64 << 20):
        assert warc.read_warc(spark, folder, size).count() == 20
        for name, raw in broken.items():
            if size > 17 or name == "hit":
                at = Path(tempfile.mkdtemp(prefix="spark-")) / "x.warc.gz"
                at.write_bytes(raw)
                with pytest.raises(Exception, match="x.warc.gz: broken record"):
                    warc.read_warc(spark, f"file://{at}", size).select("record_id").collect()


# --- 2

piece = st.sampled_from(["<|im_start|>", "<|im_end|>", "<|nl|>", "<\\|", "<|", "|>", "\\", "\n", "user", "<", "é", ""])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(piece, max_size=4).map("".join), st.lists(piece, max_size=6).map("".join)), max_size=4))
def test_chat_round_trip(turns):
    parser = chat.Parser()
    whole = "".join(chat.render_until_identical(r, t) for r, t in turns)
    got = [x for i in range(0, len(whole), 7) for x in parser.feed(whole[i : i + 7])]
    parser.close()
    assert [(r, t) for r, t, _, _ in got] == turns
    assert all(chat.unescape(whole[at : at + len(raw)]) == t for _, t, raw, at in got)


def test_chat_digests(spark):
    said = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, None, "system", "s")]
    df = spark.createDataFrame([(*x, 7) for x in said], "conv_id long, turn long, role string, text string, formatted long")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    assert set(got) == {1, 2, None} and [got[k].n_turns for k in (1, 2, None)] == [2, 3, 1]
    assert got[1].turns_sha256 == hashlib.sha256("user\na\nassistant\nb<|im_end|>\n".encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (11, hashlib.sha256(b"b<|im_end|>").hexdigest())
    assert (got[2].loss_chars, got[None].loss_chars) == (2, 0)
    assert chat.conversation_digests(chat.format_turns(df.filter("false"))).count() == 0


def test_chat_query(spark, tmp_path):
    r = random.Random(4)
    said = [(c, t, ("user", "assistant", "system")[(c + t) % 3], " ".join(prose(100 * c + t, r.randint(0, 9)))) for c in range(7) for t in range(r.randint(1, 6))] + [(3, 9, "assistant", None)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    own = "<|im_end|><|im_start|>assistant ok"
    turns = defaultdict(list)
    for c, _, role, text in sorted(said + [(-1, 0, "user", own), (-1, 1, "assistant", own)], key=lambda x: x[:2]):
        turns[c].append((role, text or ""))
    got = {r.conv_id: r for r in registry.op2_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == set(turns)
    for c, pairs in turns.items():
        loss = "".join(t for role, t in pairs if role == "assistant")
        size = sum(len(f"<|im_start|>{role}\n{t}<|im_end|>\n") + t.count("<|") for role, t in pairs)  # a backslash more for each control string
        assert (got[c].n_turns, got[c].turns_sha256) == (len(pairs), hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in pairs).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)


# --- 3


def test_substring(spark, docs, rows):
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    want = []
    for i, t in rows:
        w, gone = words(t), set()
        for j in range(len(w) - 49):
            if i is not None and first[tuple(w[j : j + 50])] < i:
                gone |= set(range(j, j + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert sorted(map(tuple, substring.drop_copied(docs).collect()), key=str) == sorted(want, key=str)
    assert substring.drop_copied(docs.filter("false"), with_text=False).count() == 0
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(words(t))
    found = substring.copy_factors(docs).collect()
    assert found
    for r in found:  # every factor is a copy of its source, and they don't overlap
        end = 0
        for f in r.factors:
            assert f.start >= end and f.source < r.doc_id
            end = f.start + f.n_words
            assert any(x[f.start : end] == y[f.source_start : f.source_start + f.n_words] for x in texts[r.doc_id] for y in texts[f.source])
        if r.doc_id == 10:
            assert len(r.factors) <= 3


def test_factors_run_on_through_blocks_and_borders(spark):
    a, b = prose(61, 900), prose(62, 400)
    said = [(1, a), (2, b), (3, a[:500] + b[:300] + ["new"] + a[500:520] + b[10:90] + a[100:900]), (3, a[40:100]), (3, a[40:100])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in said], "doc_id long, text string")
    got = {len(r.factors): [(f.start, f.n_words, f.source, f.source_start) for f in r.factors] for r in substring.copy_factors(df).collect()}
    assert got == {1: [(0, 60, 1, 40)], 4: [(0, 500, 1, 0), (500, 300, 2, 0), (821, 80, 2, 10), (901, 800, 1, 100)]}
    assert sorted(r.n_removed for r in substring.drop_copied(df).filter("doc_id = 3").collect()) == [60, 60, 1680]


# --- 4


def test_pfair(spark, docs, rows):
    many = spark.range(700).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, "b").otherwise("c").alias("source"))
    got = mixing.mix(many, {"a": 0.5, "b": 0.2, "c": 0.3}, block_rows=5, buckets=4).collect()
    assert len({r.position for r in got}) == 700 and all(r.release <= r.slot < r.due for r in got)
    blocks = sorted({(r.slot, r.source) for r in got})
    seen: dict[str, int] = defaultdict(int)
    last = min(max(s for s, x in blocks if x == src) for src in "abc")
    for n, (slot, source) in enumerate(blocks, 1):
        seen[source] += 1
        if slot < last:
            assert all(abs(seen[s] - n * w) < 1 for s, w in (("a", 0.5), ("b", 0.2), ("c", 0.3)))
    assert sorted(r.doc_id for r in mixing.mix(docs).collect() if r.doc_id is not None) == sorted(i for i, _ in rows if i is not None)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == len(rows)
    assert mixing.mix(docs.filter("false")).count() == 0


@pytest.mark.parametrize("weights", [{"a": 12345, "b": 87655}, {"a": 1, "b": 3, "c": 3, "d": 3, "e": 7919, "f": 20011}, {f"s{i:02}": 1 + i * i * 37 % 1009 for i in range(40)}])
def test_pfair_deviation_over_many_slots(spark, weights):
    total, slots = sum(weights.values()), 100_000 if len(weights) < 5 else 20_000
    table = spark.createDataFrame([(s, max(1, w * slots // total), w) for s, w in weights.items()], "source string, n_docs long, weight long")
    classes = mixing.weight_classes(table, F.col("source")).cache()
    got = mixing.pfair_slots(classes, 4096, 1).filter(f"slot < {slots}").join(classes, "weight").filter("turn % members = member").select("_name", "slot").toPandas().sort_values("slot")
    at = got.slot.to_numpy()
    assert (at == np.arange(len(at))).all() and len(at) >= 0.9 * slots
    for s, w in weights.items():
        count = np.append(0, np.cumsum(got["_name"].to_numpy() == s))
        exact = np.arange(len(count)) * w
        assert (np.abs(count * total - exact) < total).all()


def test_pfair_chunks_go_on_where_the_last_one_ended(spark):
    r = random.Random(5)
    for slots in (64, 100):
        kinds = sorted({r.choice([r.randint(1, 60), r.randint(1, 900)]): r.randint(1, 4) for _ in range(7)}.items())
        total = sum(w * m for w, m in kinds)
        table = [(f"{w}.{j}", w, max(1, w * 600 // total), m, j, total) for w, m in kinds for j in range(m)]
        got = mixing.pfair_slots(spark.createDataFrame(table, "_name string, weight long, n_docs long, members long, member long, total long"), slots, 1).collect()
        done, p = [0] * len(kinds), [w * m for w, m in kinds]
        for t, x in enumerate(sorted(got, key=lambda x: x.slot)):
            i = min((-(-(done[i] + 1) * total // p[i]), i) for i in range(len(p)) if done[i] * total < (t + 1) * p[i])[1]
            assert (x.slot, x.weight, x.turn) == (t, kinds[i][0], done[i])
            done[i] += 1


# --- 5


def test_quality(spark, docs, rows, sf_dir):
    labels = spark.createDataFrame([(i, 1, 0) for i in (10, 14, 100, 101, 102)] + [(None, 1, None), (103, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    for i, t in rows:
        if i is None:
            continue
        w = words(t)
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        repeat = {k for j, g in enumerate(grams) if grams.count(g) > 1 for k in (j, j + 1, j + 2)}
        lines, seen, doubled = (t or "").split("\n"), set(), 0
        for x in lines:
            doubled += bool(words(x)) and x in seen
            seen.add(x)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), doubled, len(repeat))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))
    assert got[10].kept and got[110].kept
    assert quality.quality_scores(docs, labels.filter("false")).filter("not kept and not base_failed").count() == 0
    assert quality.quality_scores(docs.filter("false"), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_verdict_is_the_multinomial_ratio(spark, docs, rows):
    trusted = {10, 14, 100, 101, 102}
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(105, 1, 1), (106, 0, 0)], "doc_id long, quality int, toxic int")

    def grams(t: str | None) -> list[int]:
        b = (t or "").encode()
        return [(((b[i] * 257 + b[i + 1]) * 257 + b[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(b) - 2)]

    raw, good = defaultdict(int), defaultdict(int)
    for i, t in rows:
        for g in grams(t):
            raw[g] += 1
            good[g] += i in trusted
    n_raw, n_good = sum(raw.values()), sum(good.values())
    prior = 50_000 * max(1, 500_000 / n_good)
    ratio = {g: round(math.log((good[g] + prior * n / n_raw) / (n_good + prior) / (n / n_raw)) * (1 << 20)) for g, n in raw.items()}
    for threshold in (-0.4, -0.001, 0.0):
        got = sorted(quality.quality_scores(docs, labels, threshold).collect(), key=lambda r: str((r.doc_id, r.n_words)))
        verdicts = set()
        for r, (_, t) in zip(got, sorted(rows, key=lambda x: str((x[0], len(words(x[1]))))), strict=True):
            want = sum(ratio[g] for g in grams(t))
            assert abs(r.score_sum - want) <= r.n_grams and r.n_grams == len(grams(t))
            if abs(want / (1 << 20) - threshold * r.n_grams) > 1e-3:
                assert r.kept == (not r.base_failed and want / (1 << 20) >= threshold * r.n_grams)
            verdicts.add(r.kept)
        assert threshold < -0.1 or verdicts == {True, False}


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01", "sf0.1"])
def test_quality_keeps_held_out_good_documents(spark, sf_dir, table):
    d, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', table)}/{t}.parquet") for t in ("documents", "labels"))
    held = quality.quality_scores(d, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    assert held and np.mean([r.kept for r in held if r.quality == 1 and not r.toxic]) > 0.95
    if table == "sf0.1":  # enough labels of each language to reject by
        assert np.mean([r.kept == (r.quality == 1) for r in held]) > 0.95


# --- 6

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(x: str) -> list[tuple[int, int, int]]:
    figures = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(x)] + [(1, *m.span()) for m in IP.finditer(x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(x) if 16 <= len(figures(m)) <= 19 and luhn(figures(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(x) if 8 <= len(figures(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["1", "25", ".", "@", "a", "-", "+", "(", ")", " ", "é", "4111111111111111", "10.0.0.1", "a@b.c", "+1 234"]), max_size=20).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == base(text)


def test_personal_data(spark, docs, rows, sf_dir):
    corpus = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    tagger = pii.train_tagger(corpus.filter("doc_id % 2 = 0"), steps=300)
    got = {r.doc_id: r for r in pii.personal_data(docs, tagger).collect()}
    for i, t in rows:
        if i is not None:
            b = base(t or "")
            assert got[i].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in b).encode()).hexdigest()
            assert {f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in b} <= set(got[i].spans.split(","))
            assert got[i].n_added == len([x for x in got[i].spans.split(",") if x]) - len(b)
    found = known = right = 0  # spans that the patterns miss, in texts that the tagger hasn't seen
    held = [r.text for r in corpus.filter("doc_id % 2 = 1").collect() if r.text]
    changed = [pii.labelled(text, np.random.default_rng([9, i]), rewrites=1.0) for i, text in enumerate(held)]
    for (text, gold), (plain, every) in zip(changed, pii.find_spans([t for t, _ in changed], tagger), strict=True):
        assert plain == base(text) and set(plain) <= set(every)
        missed, added = set(gold) - set(plain), set(every) - set(plain)
        found += len(missed & added)
        known += len(missed)
        right += len(added)
    assert known > 200 and found / known > 0.8 and found / right > 0.9
    real = pii.personal_data(corpus, tagger).agg(F.sum("n_added")).first()[0]
    assert real > 0
    clean = {r.doc_id: r.text for r in pii.redact(docs, tagger).collect()}
    assert not base(clean[33]) and clean[14] == dict(rows)[14] and "[EMAIL]" in clean[33] and clean[20] is None and clean[21] == ""
    assert pii.redact(docs, tagger).count() == len(rows) and pii.redact(docs.filter("false"), tagger).count() == 0
    assert pii.train_tagger(docs.filter("false")) is None and pii.personal_data(docs.filter("false"), None).count() == 0


def test_windows_of_a_very_long_text_join_as_those_of_its_parts():
    tagger = pii.Tagger()
    codes, tags = pii.training_windows([f"write to a{i}.b@mail{i}.example.com or call +1 (555) 555-{1000 + i} before the end of it" for i in range(60)], 6)
    tagger.fit(codes.astype(np.int64), tags.astype(np.int64), 120)
    part = "some words stand here, none of them a figure, " * 5 + "call (201) 555-1234 now, " + "and more words follow after it all, " * 5
    (_, one), (_, many) = pii.find_spans([part, part * 300], tagger)
    assert many == [(k, s + i * len(part), e + i * len(part)) for k in range(5) for i in range(300) for kk, s, e in one if kk == k]


# --- 7


def test_token_files(spark, docs, rows, monkeypatch):
    from tokenizers import Tokenizer

    path, folder = P.path("byte_bpe_50k.json"), new_folder(spark, "tokens")
    tokenfile.write_tokens(docs, folder, path, file_tokens=3000, match_added=True)
    read = tokenfile.read_tokens(spark, folder, 1).collect()
    t = Tokenizer.from_file(path)
    at = 0
    for (i, text), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0], x[1] is not None, x[1])), sorted(read, key=lambda r: r.start), strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, np.frombuffer(r.tokens, "<u4").tolist()) == (i, at, ids)
        at += len(ids)
    empty = new_folder(spark, "tokens")
    assert tokenfile.write_tokens(docs.filter("false"), empty, path).count() == 0


def test_pieces_are_the_library_s(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    encoder, r = tokenfile.tokenizer_encoder(P.path("byte_bpe_50k.json")), random.Random(11)
    texts = ["".join(r.choice(["  ", " ", "\n", "\t", "a", "Zb", ".", ",'", "'s", "12", "é", "漢", "\x1c", "\u3000", "!", " \n", "_"]) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    texts += ["", " ", "  ", "\n", "a ", " a", "a  ", None, "long " * 200_000 + "\n end", "x" * 3000]
    for limit in (900_000, 50):
        encoder.limit = limit
        got = encoder.encode_batch(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert encoder.encode_batch(texts[:40]) == got[:40]
    with pytest.raises(ValueError, match="byte-level"):
        tokenfile.tokenizer_encoder(P.path("word_bpe_49k.json"))


def test_token_query_matches_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    texts = ["a <|endoftext|> b", "plain text", "<|endoftext|><|endoftext|>", "x<|endoftext|", None, " <|endoftext|>\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in sorted(registry.op7_token_files(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id):
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(tokenfile, "LANES", 16)
    r = np.random.default_rng(1)
    lengths = np.array([1, 700, 3, 1800, 499, 1, 1, 40])
    tokens = (r.zipf(1.3, lengths.sum()) % 70_000).astype(np.uint32)
    raw = b"".join(tokenfile.file_bytes([5, None, 7, 8, 9, 10, 11, 12], lengths, tokens))
    path = tmp_path / "a.ranstok"
    path.write_bytes(raw)
    ends = np.cumsum(lengths)
    for step in (1, 2, 100):
        got = [d for first in range(0, 7, step) for d in tokenfile.TokenFile(str(path), len(raw)).documents(first, first + step)]
        assert [d[0] for d in got] == [5, None, 7, 8, 9, 10, 11, 12]
        assert all((x == tokens[e - n : e]).all() and s == e - n for (_, s, x), e, n in zip(got, ends, lengths, strict=True))
    path.write_bytes(raw[:20] + bytes([raw[20] ^ 1]) + raw[21:])
    with pytest.raises(ValueError, match="damaged"):
        list(tokenfile.TokenFile(str(path), len(raw)).documents(0, 1))


# --- 8


def test_jaccard(spark, docs, rows):
    per = defaultdict(list)
    for i, t in rows:
        if i is not None and words(t):
            per[tuple(words(t))].append(i)
    sets = {k: {k[j : j + 5] for j in range(max(1, len(k) - 4))} for k in per}
    links, parent = defaultdict(int), {min(v): min(v) for v in per.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in per:
        for b in per:
            if a is not b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += len(per[b])
                x, y = sorted((find(min(per[a])), find(min(per[b]))))
                parent[y] = x
    want = [(i, find(min(v)), links[k] + len(v) - 1) for k, v in per.items() for i in v] + [(i, i, 0) for i, t in rows if i is None or not words(t)]
    for bucket in (128, 2):
        got = jaccard.jaccard_join(docs, bucket=bucket, tile=3)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    kept = [r.doc_id for r in jaccard.drop_near(docs).collect()]
    assert sorted(i for i in kept if i is not None) == sorted({find(min(v)) for v in per.values()} | {i for i, t in rows if i is not None and not words(t)}) and kept.count(None) == 2
    assert jaccard.jaccard_join(docs.filter("false")).count() == 0


def test_jaccard_ids_with_several_texts(spark):
    a, b, c = prose(71, 80), prose(72, 80), prose(73, 80)
    near = lambda w, i: " ".join([*w[:i], "edit", *w[i + 1 :]])
    said = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 20)), (3, near(a, 60)), (4, near(b, 40)), (5, " ".join(c)), (5, " ".join(c)), (9, near(c, 4))]
    df = spark.createDataFrame([(i, t, 0) for i, t in said], "doc_id long, text string, rep long")
    got = sorted(map(tuple, jaccard.jaccard_join(df, threshold=0.7).collect()))
    assert got == [(1, 1, 1), (1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 1), (5, 5, 2), (5, 5, 2), (9, 5, 2)]


def test_jaccard_recall_where_every_node_is_large(spark):
    r, common = random.Random(8), prose(80, 40)
    said = []
    for k in range(150):  # pairs of 0.8 or little more, in documents that all share most of their words
        own = prose(1000 + k, 24)
        twin = list(own)
        twin[r.randint(5, 18)] = "other"
        said += [common + own, common + twin]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in said]
    want = sum(5 * len(x & y) >= 4 * len(x | y) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(said)], "doc_id long, text string")
    assert want >= 300
    got = jaccard.jaccard_join(df, bucket=8).agg(F.sum("n_links")).first()[0]
    assert got >= 0.97 * want


def test_jaccard_loose_group_ends_at_its_first_level(spark, monkeypatch):
    """Of a large group, some tens of members not near a node's pivot are compared with all there; the group doesn't go down all levels."""
    rng, n = np.random.default_rng(8), 60
    base, other = rng.integers(0, 1 << 32, (2, jaccard.COORDINATES)).astype(np.uint32)
    own = rng.integers(0, 1 << 32, (n, jaccard.COORDINATES)).astype(np.uint32)
    half = np.arange(jaccard.COORDINATES) < 32
    sigs = np.where(half, base, np.where((np.arange(n) % 3 == 0)[:, None], other, own))  # a third is one text's copies, the rest shares half with all
    reps = materialise(spark.createDataFrame([(i, sigs[i].tobytes()) for i in range(n)], "rep long, sig binary"), "reps")
    nodes, real = [], jaccard.materialise

    def counted(df, label="table"):
        out = real(df, label)
        if label == "nodes":
            nodes.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    edges = jaccard.candidate_edges(reps, 0.8, 0.99, 15, 4, 0.6, 0.9)
    parts = {r.node: r.component for r in jaccard.connected_components(edges).collect()}
    assert parts == {i: 0 for i in range(0, n, 3)}
    assert len(nodes) == 1, nodes


def test_jaccard_runs_allow_for_every_choice(spark, monkeypatch):
    asked, real = [], jaccard.runs_for
    monkeypatch.setattr(jaccard, "runs_for", lambda *a: asked.append(real(*a)) or asked[-1])
    reps = spark.createDataFrame([(1, bytes(4 * jaccard.COORDINATES))], "rep long, sig binary")
    jaccard.candidate_edges(reps, 0.8, 0.99, 128, 4, 0.6, 0.9)
    missed = 1.0  # by a pair at the threshold in one run: the root and four levels choose
    for choice in range(5):
        missed = np.exp(-(1 - missed)) if choice else np.exp(-1.0)
    assert 1 - missed ** asked[0] >= 0.99


# --- 9


def test_vectors(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((60, 8))
    x[20:35] = x[3] + 0.1 * r.standard_normal((15, 8))
    x[40] = x[41] = x[42]
    odd = [(100, None), (101, [0.0] * 8), (102, [1.0, float("nan")] + [0.0] * 6), (103, [1.0, None] + [0.0] * 6), (104, [float("inf")] * 8), (105, []), (None, x[3].tolist()), (106, [1.0, 2.0]), (107, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)] + [(i, v, 1, 2) for i, v in odd], "vec_id long, embedding array<double>, label int, id long")
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.9
    deg = cos.sum(1) - 1
    for tile in (1024, 4):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, tile=tile, window=4, block=16).collect()}
        assert all(got[i][0] == deg[i] for i in range(60))
        assert all(got[i][1] == 3 for i in range(20, 35)) and got[41] == (2, 40, False) and got[3][2]
        assert all(got[i] == (0, i, True) for i in (100, 101, 102, 103, 104, 105, None)) and got[107] == (1, 106, False)
    assert vectors.near_vectors(df.filter("false")).count() == 0
    twice = spark.createDataFrame([(1, x[3].tolist()), (1, x[50].tolist()), (2, (x[3] * 2 + 0.01).tolist()), (3, (x[3] * 3 - 0.01).tolist()), (4, (x[50] * 2 + 0.01).tolist())], df.select("vec_id", "embedding").schema)
    assert sorted(map(tuple, vectors.near_vectors(twice).collect())) == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 1, False)]


def test_windows_reach_over_partitions(spark):
    x = np.random.default_rng(6).standard_normal((700, 6))
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.97
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    parts = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = vectors.near_vectors(df, threshold=0.97, passes=1, window=700, block=800, recall=0.0)  # one pass in 40 partitions meets every pair
        assert [r.n_links for r in sorted(got.collect())] == (cos.sum(1) - 1).tolist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts[1])


def test_vectors_recall_follows_the_number_of_rows(spark):
    r = np.random.default_rng(12)
    x = r.standard_normal((8000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = r.standard_normal((600, 32))
    noise -= (noise * x[:600]).sum(1, keepdims=True) * x[:600]
    y = 0.905 * x[:600] + np.sqrt(1 - 0.905**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.concatenate([x, y])
    pairs = sum(((x[i : i + 1000] @ x.T) >= 0.9).sum() for i in range(0, len(x), 1000)) - len(x)
    assert pairs >= 1200
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for window, probe in ((1, 1 << 16), (1, 2000)):  # as deep as 64 in half a million rows
        assert vectors.near_vectors(df, window=window, block=64, probe=probe).agg(F.sum("n_links")).first()[0] >= 0.9 * pairs


# --- 10


def test_bpe_codec():
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    c, known = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(9)
    texts = ["".join(r.choice(" \n\tab.,'s1é漢! \x1c |日本") for _ in range(r.randint(0, 50))) for _ in range(1500)] + ["don't <|endoftext|>", "x" * 3000, " " * 50, "  a"]
    got = c.encoder.encode_batch(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [known.encode_ordinary(t) for t in texts]
    assert [c.decode(g) for g in got] == [t.encode() for t in texts]
    long = " ".join(prose(1, 5000))
    assert "".join(pretokens.safe_chunks(long, 1000)) == long and len(list(pretokens.safe_chunks(long, 1000))) > 5


def test_bpe_documents(spark, docs, rows):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.decode_documents(bpe.encode_documents(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in got), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert bpe.encode_documents(docs.filter("false"), path, P.PATTERN).count() == 0


def test_bpe_query(spark, tmp_path):
    import tiktoken

    known = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = ["a <|endoftext|> b", None, "", "  two  spaces \n\n and\ttabs \n", "日本 é 12 it's", "word " * 150_000, " \x1c x"] + [" ".join(prose(i, 40)) for i in range(20)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in registry.op10_byte_bpe(spark, str(tmp_path)).collect():
        ids = known.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


# --- all together


def test_pipeline_stages_on_odd_tables(spark, docs, tmp_path):
    import corpus_pipeline

    odd = docs.withColumns({c: F.lit(7) for c in ("position", "slot", "block", "rank", "weight", "copy", "row", "kept", "tag", "_row")})
    spark.createDataFrame([(10, 1, 0), (None, 1, None), (100, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    n = docs.count()
    for table, size in ((odd, n), (odd.filter("false"), 0), (odd.filter("text is null"), docs.filter("text is null").count())):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, str(tmp_path))
            rows = got.collect()
            if name != "token_ids":
                assert got.columns == odd.columns
            if name in ("personal_data", "mixture", "token_ids"):
                assert len(rows) == size
            assert len(rows) <= size
    corpus = odd.drop("_row")
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len(ran) < n and len({r.position for r in ran}) == len(ran)



def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "personal_data", "mixture", "token_ids"]
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        path = new_folder(spark, name)
        stage(spark, before, sf_dir).write.parquet(path)
        kept = spark.read.parquet(path)
        if name == "quality":
            scores = quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept")
            assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in scores.collect())
        elif name == "near_duplicates":
            old = {r.doc_id: set(zip(*(words(r.text)[k:] for k in range(5)), strict=False)) for r in before.collect()}
            ids = sorted(r.doc_id for r in kept.collect())
            near = lambda a, b: 5 * len(old[a] & old[b]) >= 4 * len(old[a] | old[b])
            assert not any(near(a, b) for a in ids for b in ids if a < b)
            assert all(any(near(a, b) for b in old if b < a) for a in old if a not in ids)
        elif name == "personal_data":
            assert not any(base(r.text) for r in kept.collect()) and kept.count() == before.count()
        elif name == "mixture":
            assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, before.collect()))
        if name != "token_ids":
            assert kept.columns == docs.columns
    c = bpe.codec(corpus_pipeline.RANKS, P.PATTERN)
    assert {r.doc_id: c.decode(r.ids).decode() for r in kept.collect()} == {r.doc_id: r.text for r in before.collect()}


def test_pipeline_keeps_the_mixture(spark):
    import corpus_pipeline

    n = {"a": 3200, "b": 800, "c": 200}
    rows = [(1000 * i + k, "some text", "en", s) for i, s in enumerate(n) for k in range(n[s])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    got = corpus_pipeline.token_ids(spark, corpus_pipeline.mixture(spark, docs, ""), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows) and len({r.position for r in got}) == len(rows)
    weight = {s: n[s] ** 0.5 / sum(x**0.5 for x in n.values()) for s in n}
    blocks = sorted({(r.position // 32, r.source) for r in got})
    ends, seen = min(max(t for t, s in blocks if s == x) for x in n), defaultdict(int)
    for t, s in blocks:
        seen[s] += 1
        if t < ends:
            assert all(abs(seen[x] - (t + 1) * weight[x]) < 1 for x in n)


def test_token_ids_number_what_the_stage_before_left(spark):
    import corpus_pipeline

    docs = spark.range(3000).selectExpr("id as doc_id", "'some text' as text", "'en' as lang", "if(id % 3 = 0, 'a', 'b') as source").repartition(4)
    mixed = corpus_pipeline.mixture(spark, docs, "")
    in_order = [r.doc_id for r in mixed.collect()]
    stored = materialise(mixed, "mixed")
    for given in (mixed, stored, stored.select("text", "source", "lang", "doc_id")):
        got = {r.position: r.doc_id for r in corpus_pipeline.token_ids(spark, given, "").collect()}
        assert [got[k] for k in range(3000)] == in_order
    other = materialise(docs.repartitionByRange(3, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")), "unmixed")
    assert {r.position: r.doc_id for r in corpus_pipeline.token_ids(spark, other, "").collect()} == {k: 2999 - k for k in range(3000)}


def test_rest_tiles_read_the_members_once(spark):
    members = spark.range(40).selectExpr("id % 2 as node", "id as rep", "binary('') as sig", "id % 5 = 0 as joined")
    counts = members.groupBy("node").agg(F.count_if(~F.col("joined")).alias("open"), F.count_if("joined").alias("done"))
    tiles = jaccard._rest_tiles(materialise(members, "members"), materialise(counts, "counts").filter("node = 1"), 3)
    assert tiles._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    met = defaultdict(set)
    for r in tiles.collect():
        met[r.node, r.tile_a, r.tile_b].add(r.rep)
    pairs = {(a, b) for t in met.values() for a in t for b in t if a < b}
    assert pairs >= {(a, b) for a in range(1, 40, 2) for b in range(a + 2, 40, 2) if a % 5 or b % 5} and {x for p in pairs for x in p} == set(range(1, 40, 2))


def test_piece_encoder_keeps_words_that_come_again():
    import regex

    from itemlake.llm.pretokens import PieceEncoder

    asked = []

    def encode_many(pieces):
        asked.extend(pieces)
        return [list(p.encode()) for p in pieces]

    encoder = PieceEncoder(regex.compile(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall, encode_many, 40)
    texts = [f"x often often. (often) rare{'abcdefghij'[i % 10] * (i // 10 + 1)} {i}th.\n often\n\n  of{i}" for i in range(60)]
    for t in texts:
        assert encoder.encode(t) == b"".join(int(x).to_bytes(4, "little") for x in t.encode())
    assert asked.count(" often") == 1  # alone and before a point, and again after others were forgotten
    assert len(encoder.words) + len(encoder.parts) + len(encoder.pieces) < 100
    encoder.limit = 0
    assert encoder.encode(" a\x00b　 c") == b"".join(int(x).to_bytes(4, "little") for x in " a\x00b　 c".encode())
