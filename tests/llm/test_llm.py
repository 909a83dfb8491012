"""The pipeline operators against brute force, on the small tables and on odd rows."""

import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from statloom.llm import bpe, embeddings, imatch, mixing, ngram_join, pii, quality, rows, token_counts, url_lm, warc

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"wörd{i} x{i}. it's" for i in range(9000))
ODD = ["", None, "a", "a", " ", "a  b \n c<|endoftext|> d", "..a,b. ,c’s 1.2", LONG, "漢字" * 300, "x\x00.y"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None, i, "mine") for i, t in enumerate(ODD)] + [(2, "a", "en", None, 2, "mine"), (None, "b c", None, "s", 3, "mine")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ids long, n_tokens string")


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def test_token_counts(spark, docs, odd):
    library = Tokenizer.from_file(BYTE)
    for df in (docs, odd):
        for r in token_counts.count_tokens(df, BYTE).collect():
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 512)
    assert sorted(token_counts.count_tokens(odd, BYTE).columns) == sorted([*odd.columns, "n_bytes", "over_limit"])
    assert token_counts.count_tokens(odd.limit(0), BYTE).count() == 0


def test_bpe_round(spark, docs, odd):
    library = Tokenizer.from_file(WORD)
    for df, leaf in ((docs, 512), (odd, 64), (odd.limit(0), 64)):
        coded = bpe.decode(bpe.encode(df, WORD, leaf_chars=leaf), WORD).collect()
        assert len(coded) == df.count()
        for r in coded:
            want = library.encode(r.text or "", add_special_tokens=False).ids
            assert list(r.ids) == want
            assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_decoding_keeps_the_vocabulary_out_of_the_plan(spark):
    df = spark.createDataFrame([([5, 7, -1, 10**9],), (None,), ([],)], "ids array<int>")
    out = bpe.decode(df, WORD)
    library = Tokenizer.from_file(WORD)
    assert [r.decoded for r in out.collect()] == [f"{library.id_to_token(5)} {library.id_to_token(7)}", "", ""]
    assert len(out._jdf.queryExecution().toString()) < 20_000



def test_words_are_cut_where_their_lower_case_still_ends_in_a_letter():
    coder, library = bpe.Encoder(WORD), Tokenizer.from_file(WORD)
    rng = random.Random(8)
    texts = ["HABERLER GELDİ.", "İ.", "İ, İ .İ.", "ΑΣ. ΑΣ,Α", "Straße. ẞ, ŉ. ǰ,", "É. é, e\u0301. ﬁ."]
    texts += ["".join(rng.choice("aİiI.,  éΣßŉA1'") for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    for text, got in zip(texts, coder.encode(texts)):
        assert np.frombuffer(got, np.int32).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_bpe_forgets_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2000)
    coder = bpe.Encoder(WORD)
    for i in range(40):
        coder.encode([f"word{i} other{i * 7}"])
        assert coder.held <= 2000 + 2 * (20 + 40 + bpe.BESIDE)
    coder.forget()
    assert not coder.known and coder.held == 0


def test_bpe_hands_ids_on_run_by_run_and_gives_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(rows, "give_back", lambda: calls.append(1))
    monkeypatch.setattr(bpe, "BATCH_BYTES", 1000)
    texts = [f"some words {i} " * (i % 40) for i in range(300)] + [None, ""]
    got = list(bpe._encoder(WORD)(iter([pa.array(texts, pa.string()), pa.array([], pa.string())])))
    library = Tokenizer.from_file(WORD)
    assert [x for a in got for x in a.to_pylist()] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(got) > 50 and len(calls) == 2


def test_bpe_joins_anywhere():
    rng, coder = random.Random(5), bpe.Encoder(WORD)
    alphabet = list("abAB12 é́Σ's漢.!\n") + ["<|endoftext|>", "<|startoftext|>", "  "]
    for k in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))).replace(" " if k % 3 == 0 else "\0", "")
        n = rng.choice([2, 4, 8])
        cut = [i * len(text) // n for i in range(n + 1)]
        parts = [text[a:b] for a, b in zip(cut, cut[1:])]
        got = np.frombuffer(coder.tree(list(zip(parts, coder.encode(parts)))), np.int32).tolist()
        assert got == coder.library.encode(text, add_special_tokens=False).ids


def groups(links, nodes):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def shingle_set(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(texts):
    sets, index, links = {i: shingle_set(t) for i, t in texts.items()}, collections.defaultdict(list), set()
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in index[x] if j > i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                links.add((i, j))
    return sets, links


def test_ngram_join(spark, docs):
    rng = random.Random(3)
    texts = texts_of(docs)
    words = [f"w{i}" for i in range(400)]
    shared = [f"s{i}" for i in range(60)]
    base = 10_000
    for family in range(6):  # chains of edits, short sets, a common passage, copies
        text = [rng.choice(words) for _ in range(rng.choice([3, 7, 20, 120]))] + (shared if family % 2 else [])
        for _ in range(60):
            texts[base] = " ".join(text)
            base += 1
            if rng.random() < 0.8:
                text = list(text)
                text[rng.randrange(len(text))] = rng.choice(words)
    texts[base], texts[base + 1] = "", "\t\n"
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, rep string")
    sets, links = near(texts)
    assert len(links) > 300
    want = groups(links, texts)
    got = {r.doc_id: r for r in ngram_join.near_duplicates(df).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in texts}


def test_ngram_join_in_blocks(spark, monkeypatch):
    """Groups over many blocks: copies at all distances, a dense family beside its lead, a key of three texts."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ngram_join, "PARTNERS", 2)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(70)]
    rows = [(1, " ".join(base))]

    def edited(text, n):
        text = list(text)
        for _ in range(n):
            text[rng.randrange(len(text))] = rng.choice(words)
        return text

    for i in range(120):
        rows.append((10 + i, " ".join(edited(base, rng.randint(1, 6)))))
    beside = edited(base, 5)
    rows += [(200 + i, " ".join(edited(beside, rng.choice([0, 1])))) for i in range(40)]
    rows += [(300 + i, " ".join(base[:20] + [rng.choice(words) for _ in range(rng.randint(40, 60))])) for i in range(60)]
    apart = [[f"{c}{i}" for i in range(30)] for c in "xyz"]
    rows += [(400 + k, " ".join(a)) for k, a in enumerate(apart)] + [(410, " ".join(a)) for a in apart]
    sets, links = near(dict(enumerate(t for _, t in rows)))
    assert len(links) > 300
    joined = {(rows[a][0], rows[b][0]) for a, b in links}
    want = groups(joined, {i for i, _ in rows})
    assert len(set(want.values())) > 60
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == set(want.items())


def test_bit_maps_never_hide_a_pair():
    """What the maps say two sets may share is at least what they share, in one band and in neighbouring ones."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.2, 0.8, 1.0])], rng.integers(0, 2**64, int(rng.integers(0, n)), dtype=np.uint64)]))
        if 10 * min(len(a), len(b)) < 6 * max(len(a), len(b)):
            continue
        maps = {}
        for bits in (8, 4):
            text, value = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b])
            maps[bits] = [np.array(x, np.int64).view(np.uint64) for x in ngram_join.bit_maps(text, value, np.array([len(a), len(b)]), bits).to_pylist()]
        band = [len(x).bit_length() for x in (a, b)]
        one, two = (maps[4 if band[i] > band[1 - i] else 8][i] for i in (0, 1))
        assert len(one) == len(two)
        only = [sum(int(x & ~y).bit_count() for x, y in zip(p, q)) for p, q in ((one, two), (two, one))]
        both = len(np.intersect1d(a, b))
        assert min(len(a) - only[0], len(b) - only[1]) >= both


def test_ngram_join_keeps_every_link_in_its_keys():
    """Sets that differ by less than the threshold share a key whatever is held to be common."""
    rng = np.random.default_rng(1)
    for trial in range(200):
        n = int(rng.integers(1, 120))
        a = rng.integers(1, 2**63, n).astype(np.uint64)
        b = a[rng.random(n) > rng.choice([0.02, 0.08, 0.15])]
        b = np.concatenate([b, rng.integers(1, 2**63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(np.union1d(a, b))):
            continue
        common = np.sort(a[rng.random(n) < rng.choice([0, 0.3, 0.8, 1.0])])
        pair = [np.sort(np.unique(x)) for x in (a, b)]
        doc = np.repeat([0, 1], [len(x) for x in pair])
        docs, keys = ngram_join.keys_of_sets(doc, np.concatenate(pair), common)
        assert np.intersect1d(keys[docs == 0], keys[docs == 1]).size, (trial, n, len(b))


def test_ngram_join_odd_rows(spark, odd):
    got = ngram_join.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert (by[0].n_shingles, by[0].component_id, by[3].component_id, by[None].component_id) == (0, 0, 2, None)
    assert ngram_join.near_duplicates(odd.limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 24))
    near_ones = x[:120] + rng.normal(size=(120, 24)) * 0.17
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(np.concatenate([x, near_ones, np.tile(x[:1], (30, 1))]))]
    rows += [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] + [1.0] * 23), (None, [1.0] * 24), (1004, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("home", F.lit("mine"))
    good = np.array([r for _, r in rows[:550]])
    unit = good / np.linalg.norm(good, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    want = groups([(int(a), int(b)) for a, b in zip(*np.nonzero(link))], range(550))
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, margin=0.1582).collect()}
    assert len(got) == len(rows)
    for i in range(550):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), want[i], want[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(1000, 1005))
    found = sum(r.n_links for r in embeddings.near_duplicates(df).collect())
    assert found >= 0.9 * link.sum()
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("rank", [3, 8, 64])
def test_embeddings_default_margin_loses_nothing(spark, rank):
    rng = np.random.default_rng(rank)
    base = rng.normal(size=(64, rank))
    x = rng.normal(size=(1500, rank))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.normal(size=x.shape)
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.951, 0.97, size=(1500, 1))
    x = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * other]) @ np.linalg.qr(base)[0].T
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    want = groups([(int(a), int(b)) for a, b in zip(*np.nonzero(link))], range(len(x)))
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (link[i].sum(), want[i]) for i in range(len(x))}


def test_imatch(spark, docs, odd):
    for df in (docs, odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), odd.limit(0)):
        rows = sorted(texts_of(df).items(), reverse=True)
        got = {r.doc_id: r for r in imatch.edit_report(df).collect()}
        assert len(got) == len(rows)
        prints = collections.defaultdict(set)
        for i, (key, text) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][1]
            third = len(text) // 3
            edited = text[: len(text) - third] + after[:third]
            r = got[key]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            prints[text].add(r.fingerprint)
        assert all(len(p) == 1 for p in prints.values())
    mean = imatch.edit_report(docs).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert mean[0] > 0.2 > 0.1 > mean[1]
    assert imatch.fingerprints(odd).count() == odd.count()


def test_mixing(spark, docs, odd):
    targets = {"lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "source": 1.0}
    out = mixing.with_probability(docs, targets, 0.1)
    total = out.agg(F.sum("n_tokens")).first()[0]
    shares = {r.lang: r.t / total / 0.1 for r in out.groupBy("lang").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("t")).collect()}
    assert abs(sum(shares.values()) - 1) < 0.15
    assert mixing.with_probability(odd, {"source": 0.5, "lang": 1.0, "topic": 1.0}, 0.5).count() == odd.count()
    assert mixing.with_probability(odd.limit(0), {"source": 0.5}, 0.5).count() == 0


def test_mixing_keeps_values_left_out(spark):
    from statloom.llm.queries import MIX_FRACTION, MIX_TARGETS

    langs = ["en"] * 40 + ["de"] * 20 + ["fr", "es"] * 10 + ["it"] * 12 + [None] * 8
    rows = [(i, lang, "web", "some words of prose here") for i, lang in enumerate(langs)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    got = {r.lang: r.probability for r in mixing.with_probability(df, MIX_TARGETS, MIX_FRACTION).collect()}
    assert abs(got["it"] - 0.5) < 0.01 and abs(got[None] - 0.5) < 0.01
    assert all(p > 0 for p in got.values())
    none = mixing.with_probability(df, {"lang": {"en": 1.0, "it": 0.0}}, 0.5).filter("lang = 'it'").agg(F.max("probability")).first()
    assert none[0] == 0


def test_mixing_values_without_words(spark):
    """A language without words, all texts empty, and no row at all: every row has a probability."""
    rows = [(1, "en", "a", "some words"), (2, "it", "a", ""), (3, "it", "b", None), (4, "en", "b", "more words here")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    targets = {"source": 0.7, "lang": {"en": 0.6, "it": 0.4}, "topic": 0.9}
    for some in (df, df.filter("lang = 'it'"), df.limit(0)):
        got = mixing.with_probability(some, targets, 0.5).collect()
        assert len(got) == some.count() and all(0 <= r.probability <= 1 for r in got)
    assert {r.doc_id: r.probability for r in mixing.with_probability(df, targets, 0.5).collect()}[2] == 0.5


def test_mixing_meets_the_margins(spark):
    """Expected tokens meet every margin's targets when no cell is short, against raking in numpy."""
    rng = np.random.default_rng(4)
    rows = [(i, "en" if a < 0.8 else "de", f"s{min(int(-np.log(b)), 3)}", "word " * int(n)) for i, (a, b, n) in enumerate(zip(rng.random(3000), rng.random(3000), rng.integers(1, 40, 3000)))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    out = mixing.with_probability(df, {"lang": {"en": 0.65, "de": 0.35}, "source": 0.8}, 0.3).collect()
    total = sum(r.n_tokens for r in out)
    held = collections.Counter()
    for r in out:
        held[r.source] += r.n_tokens
    want = {("lang", "en"): 0.65, ("lang", "de"): 0.35} | {("source", s): n**0.8 / sum(m**0.8 for m in held.values()) for s, n in held.items()}
    for (margin, value), share in want.items():
        got = sum(r.n_tokens * r.probability for r in out if r[margin] == value) / (0.3 * total)
        assert abs(got - share) < 1e-3, (margin, value, got, share)


def test_mixing_sql_gives_values_left_out_their_share(spark, tmp_path):
    import duckdb

    langs = ["en"] * 40 + ["de"] * 20 + ["fr", "es"] * 10 + ["it"] * 12 + [None] * 8
    df = spark.createDataFrame([(i, lang, "web", "some words of prose here") for i, lang in enumerate(langs)], "doc_id long, lang string, source string, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    from statloom.llm.queries import MIX_FRACTION, MIX_TARGETS

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.execute(mixing.mix_sql(MIX_TARGETS, MIX_FRACTION))
    names = [d[0] for d in rel.description]
    want = {r[names.index("doc_id")]: r[names.index("probability")] for r in rel.fetchall()}
    got = {r.doc_id: r.probability for r in entry.queries()["op5_mixing"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in got)


def test_quality(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.learn(docs, labels.filter(~quality.held_out("doc_id")))
    test = quality.classify(docs, model).join(labels, "doc_id").filter(quality.held_out("doc_id")).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in test)
    assert np.mean([r.predicted == r.quality for r in test]) > 0.95
    rows = quality.classify(odd.withColumn("score", F.lit("mine")), model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.learn(odd, labels.limit(0)) is None
    assert {r.score for r in quality.classify(odd, None).collect()} == {0.5}


def test_pii(spark):
    text = "Mail a.b9@mail.example.com or A.B9@MAIL.EXAMPLE.COM, call +1 (555) 123-4567 or (555) 123-4567, card 4111 1111 1111 1111 not 4111 1111 1111 1112, ip 8.8.4.4 not 8.8.4.999, Mrs. Anna Smith met Mr Smith. password=hunter22"
    rows = [(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "clean 4.0, version 3.", "x"), (5, "господин Иванов, 8.8.4.4", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_entities string").withColumn("key", F.lit("mine"))
    got = pii.replace_entities(df, "secret").orderBy("doc_id").collect()
    assert got[0] == got[1] and got[0].key == "mine"
    new = got[0].text
    for old in ("a.b9@", "123-4567", "4111 1111 1111 1111 ", "8.8.4.4 ", "Anna", "Smith", "hunter22"):
        assert old not in new
    assert "4111 1111 1111 1112" in new and "8.8.4.999" in new and got[0].n_entities == 10 - 1
    words = new.replace(",", "").split()
    assert words[1].upper() == words[3]  # one entity, two spellings
    assert new.split("call ")[1].split(" or ")[0][-8:] == new.split("call ")[1].split(" or ")[1][6:14]
    assert new.split("Mrs. ")[1].split()[1] == new.split("Mr ")[1].split(".")[0]
    digits = new.split("card ")[1][:19].replace(" ", "")
    total = sum(d - 9 if d > 9 else d for d in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
    assert total % 10 == 0 and digits[0] == "4"
    assert [r.text for r in got[2:5]] == [None, "", "clean 4.0, version 3."]
    assert new.split("ip ")[1].split(" not")[0] == got[5].text.split(", ")[1]
    assert all("а" <= c <= "я" for c in got[5].text.split()[1].rstrip(",").lower())
    assert pii.replace_entities(df.limit(0), "secret").count() == 0


def test_pii_replaces_untitled_mentions(spark):
    text = "Smith? Mrs. Anna Smith came. Anna Smith said, card 4111 1111 1111 1112, that Smith's left; Smithson, Annas. Mr. Jean-Luc O'Brien-McCoy met Jean-Luc and O'Brien-McCoy"
    rows = [(1, text), (2, text), (3, "Anna Smith, call (555) 123-4567"), (4, "Mr Jones and Jones"), (5, "Anna Smith")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_entities(df, "secret").collect()}
    given, last = got[1].text.split("Mrs. ")[1].split(" came")[0].split()
    man, name = got[1].text.split("Mr. ")[1].split(" met")[0].split()
    assert not {given, last, man, name} & {"Anna", "Smith", "Jean-Luc", "O'Brien-McCoy"}
    assert got[1].text == (
        f"{last}? Mrs. {given} {last} came. {given} {last} said, card 4111 1111 1111 1112, that {last}'s left; Smithson, Annas. "
        f"Mr. {man} {name} met {man} and {name}"
    )
    assert got[2].text == got[1].text
    assert got[3].text.startswith("Anna Smith, call (") and "123-4567" not in got[3].text  # not found in that document
    jones = got[4].text.split()
    assert jones[1] == jones[3] != "Jones" and got[4].n_entities == 2
    assert (got[5].text, got[5].n_entities) == ("Anna Smith", 0)


def test_pii_surrogates_stay_distinct(spark):
    from statloom.operators.stage import Stage

    ips = [(f"{a}.{b}.1.1", "ipv4") for a in range(20, 60) for b in range(100)] + [(f"N{i}", "given_f") for i in range(900)]
    df = spark.createDataFrame(ips, "normal string, kind string")
    table = pii.surrogates(df, "k", Stage(spark, "test")).collect()
    assert len({(r.kind, r.surrogate) for r in table}) == len(ips)
    assert not {r.surrogate for r in table} & {x for x, _ in ips}


def test_pii_ends_where_the_surrogates_run_out(spark):
    """Masks, and formats whose every value is an entity, end with distinct surrogates that are no entities."""
    rows = [(1, "login password=**** ok"), (2, "password=!!!! and password=***"), (3, "password=****")]
    rows += [(10 + i, f"password={i}---") for i in range(10)] + [(30 + i, f"mail {c}@x.com") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace_entities(df, "secret").collect()}
    assert got[1].startswith("login password=") and got[1].endswith(" ok") and "*" not in got[1] and "!" not in got[2]
    assert got[1].split()[1] == got[3]  # one entity, one surrogate
    for low, high, n in ((10, 20, 10), (30, 56, 26)):
        new, old = {got[i] for i in range(low, high)}, {t for i, t in rows if low <= i < high}
        assert len(new) == n and not new & old


def test_pii_every_number_of_a_format_is_an_entity(spark, monkeypatch):
    from statloom.operators.stage import Stage

    monkeypatch.setattr(pii, "NOT_REAL", 2)
    monkeypatch.setattr(pii, "SHARED", 5)
    full = [("".join(map(str, (i, j))), "ssn") for i in range(10) for j in range(10)]
    table = pii.surrogates(spark.createDataFrame(full, "normal string, kind string"), "k", Stage(spark, "test")).collect()
    assert len(table) == 100 and {r.surrogate for r in table} <= {x for x, _ in full}


def test_pii_account_numbers_pass_their_check(spark):
    def rest(iban):
        iban = iban.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97

    texts = ["GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00", "FR1420041010050500013M02606"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.replace_entities(df, "secret").collect():
        assert rest(texts[r.doc_id]) == 1 and rest(r.text) == 1
        assert r.text[:2] == texts[r.doc_id][:2] and len(r.text) == len(texts[r.doc_id]) and r.text != texts[r.doc_id]


def test_url_filter(spark):
    rules = {"org/": "allow", "a.org/x": "block", "net/": "block"}
    urls = ["http://A.org/xy?q", "http://b.a.org/y#f", "http://aorg/x", "no scheme", None, "https://good.net", "https://good.net/p", "ftp://x.org"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls * 3)], "page_id long, url string, score string")
    got = {r.page_id: r for r in url_lm.judge(df, rules).collect()}
    assert len(got) == 24
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(8)] == [
        ("a.org", "/xy", "a.org/x"), ("b.a.org", "/y", "org/"), ("aorg", "/x", None), ("", "", None), ("", "", None),
        ("good.net", "", None), ("good.net", "/p", "net/"), ("x.org", "", None),
    ]
    assert url_lm.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_lm.judge(df, {}).collect()} == {"allow"}


def test_url_filter_reads_the_whole_url(spark):
    urls = [f"http://a.org/p?sort=good{i}" for i in range(40)] + [f"http://b.net/p?sort=xxxx{i}" for i in range(40)]
    odd = ["http://c.io/p?sort=good7", "http://c.io/p?sort=xxxx7", "sort=good3", "sort=xxxx3", "http://c.io/p#good5", "http://c.io/p#xxxx5", None]
    df = spark.createDataFrame(list(enumerate(odd + urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_lm.judge(df, {"org/": "allow", "net/": "block"}).collect()}
    assert len(got) == len(odd + urls) and got[6].score is not None
    for good, bad in ((0, 1), (2, 3), (4, 5)):
        assert got[good].score > got[bad].score and got[good].host == got[bad].host


def test_warc(spark):
    h = lambda **kw: {k.replace("_", "-"): v for k, v in kw.items()}
    rows = [
        (1, "http://A.com/p#x", 100, "response", 200, h(ETag='"1"', Date="d1", Content_Length="9"), "p1"),
        (2, "http://a.com:80/p", 90_000, "revisit", 304, h(etag='W/"1"', Date="d2", Content_Length="0"), None),
        (3, "http://a.com/p", 200_000, "response", 404, h(), "p3"),
        (4, "http://a.com/p?utm_source=f", 300_000, "revisit", 304, h(ETag='"2"'), None),
        (5, "http://a.com/p", 300_001, "revisit", 304, None, None),
        (6, "http://b.com", 5, "revisit", 304, h(ETag='"1"'), None),
        (7, None, None, "revisit", 304, h(ETag='"1"'), None),
        (8, "http://a.com/p", 50, "revisit", 304, h(ETag='"1"'), None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, seen_at long, kind string, status int, headers map<string,string>, payload_digest string")
    got = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert {i: (r.outcome, r.base_id) for i, r in got.items()} == {
        2: ("resolved", 1), 4: ("mismatch", 1), 5: ("no_validator", 1), 6: ("no_base", None), 7: ("no_base", None), 8: ("no_base", None),
    }
    assert got[2].headers == {"etag": 'W/"1"', "date": "d2", "content-length": "9"} and got[2].payload_digest == "p1"
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_queries_without_sql_run(spark):
    names = [n for n in entry.queries() if n.startswith("op") and n not in entry.oracle_sql()]
    assert len(names) == 7
    for name in names:
        assert entry.queries()[name](spark, SF).count() > 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    good = corpus_pipeline.good_quality(spark, docs, SF)
    kept = corpus_pipeline.one_of_each_group(spark, good, SF)
    assert good.columns == kept.columns == names
    low = groups(near(texts_of(good))[1], texts_of(good))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in low.items() if i == c)
    final = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in final.collect()}
    assert ids and ids <= {r.doc_id for r in kept.collect()}
    assert math.isclose(final.count(), len(ids))


def check_tokens(coded):
    library = Tokenizer.from_file(WORD)
    for r in coded.collect():
        assert (r.n_tokens, r.decoded) == (len(r.ids), library.decode(list(r.ids), skip_special_tokens=False))
        assert r.round_trip == (library.encode(r.decoded, add_special_tokens=False).ids == list(r.ids))


def test_pipeline_tokens(spark, odd):
    import corpus_pipeline

    coded = corpus_pipeline.tokenized(spark, odd, SF)
    assert coded.count() == odd.count()
    assert {r.round_trip for r in coded.collect()} >= {True}
    check_tokens(coded)
