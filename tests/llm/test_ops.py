"""Each operator against brute force, a library or a round trip, with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaria.llm import bpe_count, decontam, langid, lm_score, piece_lattice, quality, shard, simhash, transport, urlgraph
from glossaria.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens string, row string, id string"
WORDS = "the and of tion ing ent house water over under light stone river green seven".split()


def texts():
    rng = np.random.default_rng(3)
    some = [" ".join(rng.choice(WORDS, int(rng.integers(1, 60)))) for _ in range(60)]
    some += [some[0], some[1] + " the", some[2], None, "", " ", "\n\n", "a" * 5000, "x y " * 4000, "été 日本語 😀 नमस्ते", "<|endoftext|> in text", "don't   stop\t\x1c now", "Ünïcode, 12,000.5 % &&& ###"]
    return some


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["hot", "hot", "b", None][i % 4], None, 1.0, "x", "r", "i") for i, t in enumerate(texts())]
    rows += [rows[5], rows[5], (None, "no id here", "en", "hot", None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def key(rows):
    return sorted(rows, key=repr)


def none(docs):
    return docs.filter("false")


def test_token_counts(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = bpe_count.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False)), n > 512) for i, t in pairs(docs)]
    assert key(map(tuple, got.collect())) == key(want)
    assert bpe_count.count_tokens(none(docs), tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert bpe_count.token_totals(got).first().n_rows == docs.count()


def brute_dictionary(counts, size):
    out = []
    for term, n in sorted(counts.items(), key=lambda x: (-x[1] * len(x[0]), x[0])):
        if len(term) > size:
            break
        out.append(term)
        size -= len(term)
    return b"".join(reversed(out))


def test_compression_scores(docs, spark):
    long = spark.createDataFrame([(900, " ".join(f"w{i % 977} and" for i in range(9000)), "en", None, None, None, None, None, None)], SCHEMA)
    docs = docs.union(long)  # more than one block
    own = docs.filter("lang = 'en'")
    got = lm_score.compression_scores(docs, own, ["doc_id"]).collect()
    every, mine = Counter(), Counter()
    for t, lang in [(r.text, r.lang) for r in docs.collect()]:
        every.update(lm_score._terms((t or "").encode()))
        mine.update(lm_score._terms((t or "").encode()) if lang == "en" else [])
    size = max(lm_score.DICTIONARY, 64 * int(sum(len(t) * n for t, n in every.items()) ** 0.5))
    one, two = (lm_score.compressor(brute_dictionary(c, size)) for c in (mine, every))
    want = []
    for i, t in pairs(docs):
        data = (t or "").encode()
        a, b = one(data), two(data)
        want.append((i, len(data), a, b, 8 * a / len(data) if data else 0.0, 8 * b / len(data) if data else 0.0, (b - a) / (a + b) if a + b else 0.0))
    assert key(map(tuple, got)) == key(want) and any(w[1] > 2 * lm_score.BLOCK for w in want)
    assert lm_score.dictionary(lm_score.term_counts(none(docs))) == b""
    assert lm_score.compression_scores(none(docs), none(docs), ["doc_id"]).count() == 0


@pytest.mark.parametrize("bits", [1 << 27, 1 << 15])
def test_rows_of_members(spark, bits):
    from glossaria.llm.common import probable_members

    docs = spark.createDataFrame([(i % 9000 if i % 10 else None, f"t{i}") for i in range(20_000)], "doc_id long, text string")
    members = spark.range(0, 40_000, 7).select(F.col("id").alias("member"))
    near = probable_members(docs, members, "doc_id", bits)
    want = sorted(r.text for r in docs.collect() if r.doc_id is not None and r.doc_id % 7 == 0)
    assert set(want) <= {r.text for r in near.collect()} and (bits < 1 << 20 or near.count() < 1.1 * len(want))
    assert sorted(r.text for r in lm_score.rows_of(docs, members).collect()) == want
    assert lm_score.rows_of(docs, members.filter("false")).count() == 0


def test_domain_scores_higher(spark):
    rng = np.random.default_rng(1)
    mine, other = [f"domain{i}word" for i in range(400)], [f"general{i}term" for i in range(4000)]
    rows = [(i, " ".join(rng.choice(mine if i % 4 == 0 else other, 60)), i % 4 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own boolean")
    got = lm_score.compression_scores(df, df.filter("own"), ["own"]).groupBy("own").agg(F.avg("score")).collect()
    scores = dict(map(tuple, got))
    assert scores[True] > scores[False]


def test_dictionaries_grow_with_the_corpus(spark):
    counts = spark.range(400_000).select(F.concat(F.lit(" w"), F.lpad(F.hex("id"), 6, "0")).cast("binary").alias("term"), (F.col("id") % 7 + 1).alias("n"))
    size = lm_score.dictionary_size(counts)
    rows = {bytes(r.term): r.n for r in counts.collect()}
    assert size == 64 * int(sum(8 * n for n in rows.values()) ** 0.5) > 2 * lm_score.DICTIONARY
    assert lm_score.dictionary(counts, size) == brute_dictionary(rows, size)


def test_whole_dictionaries_are_used():
    terms = [b" " + hashlib.sha1(b"%d" % i).hexdigest()[:12].encode() for i in range(40_000)]
    content, far = b"".join(terms), b"".join(terms[:1500:30])
    near = lm_score.compressor(content[-lm_score.DICTIONARY :])(far)
    assert lm_score.compressor(content)(far) < 0.55 * near


def test_shards_of_many_sources_and_of_one_id(spark):
    some = spark.range(4000).select(F.when(F.col("id") < 1500, None).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"), F.when(F.col("id") < 2500, F.concat(F.lit("s"), "id")).otherwise("hot").alias("source"))
    got = shard.interleave(some, 7).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.count_distinct("slot").alias("d")).collect()
    assert sum(r.n for r in got) == 4000 and all((r.a, r.b + 1, r.d) == (0, r.n, r.n) and r.n in (571, 572) for r in got)


@pytest.mark.parametrize("n", [1, 3, 7])
def test_shards(docs, n):
    got = shard.interleave(docs, n).collect()
    rows = docs.collect()
    want = defaultdict(list)
    for r in rows:
        t = (r.text or "").encode()
        k = hashlib.md5(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        want["-" if r.source is None else "=" + r.source].append((k, -1 if r.doc_id is None else r.doc_id, zlib.crc32(t), len(t) + 16, r.doc_id))
    order = sorted(((i + 0.5) / len(v), s, *x) for s, v in want.items() for i, x in enumerate(sorted(v)))
    size = len(rows)
    placed = [(x[-1], x[5], x[4], (p * n) // size, p - ((p * n // size) * size + n - 1) // n) for p, x in enumerate(order)]
    assert key((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == key(placed)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert shard.interleave(none(docs), n).count() == 0


def brute_contamination(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = [(str(i), w[a : a + 10]) for i, t in items for w in [cut(t)] if w for a in range(max(1, len(w) - 9))]
    for d, t in rows:
        w, hit, found = cut(t), set(), set()
        for i, x in windows:
            for a in range(len(w) - len(x) + 1):
                if w[a : a + len(x)] == x:
                    hit.update(range(a, a + len(x)))
                    found.add(i)
        yield d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [None, 40])
def test_contamination(spark, docs, monkeypatch, block):
    if block:
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    own = [t for t in texts() if t and len(t.split()) > 15]
    items = [(1, " ".join(own[0].split()[2:14])), (2, "zzz"), (3, "House"), (10, "the AND"), (7, own[1].upper()), (8, None), (9, ""), (11, own[3] + " zzz"), (12, "x y " * 9)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, table)
    want = list(brute_contamination(pairs(docs), items))
    assert key(map(tuple, got.collect())) == key(want)
    assert sum(w[-1] for w in want) > 5
    if not block:
        assert decontam.contamination(none(docs), table).count() == 0
        assert decontam.contamination(docs, table.filter("false")).filter("contaminated").count() == 0


def test_long_items_are_cut(spark):
    rng = np.random.default_rng(12)
    item = " ".join(f"w{i}" for i in rng.integers(0, 2_000_000, 1_200_000))  # more words than 20 bits number
    own = item.split()
    texts = [" ".join(own[a : a + 12]) for a in (0, 499_985, 499_990, 499_995, 900_000, 1_199_988)] + ["w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontam.contamination(docs, spark.createDataFrame([(5, item), (6, texts[1])], "item_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_hit for r in got] == [12] * 6 + [0] and [r.n_items for r in got][:2] == [1, 2]


def test_transport(docs, spark):
    got = {(r.doc_id, r.n_bytes, r.payload_sha256) for r in transport.stream_digest(docs).collect()}
    want = {(i, len((t or "").encode()), hashlib.sha256(transport.padded(t)).hexdigest()) for i, t in pairs(docs)}
    assert got == want
    assert transport.stream_digest(none(docs)).count() == 0
    media = transport.text_streams(docs)
    index = transport.index_streams(media).filter("doc_id = 67").first()
    assert index.units[0].random_access and [u.pts for u in index.units] == sorted(u.pts for u in index.units) and index.continuity_errors == 0


def test_transport_damage_and_sizes():
    for n in [*range(0, 800), 32_700, 32_768, 32_769, 300_000]:
        data = bytes(i * 7 % 251 for i in range(n))
        if n:
            got = transport.demux(transport.mux(data))
            assert got.payload() == data and not (got.continuity_errors or got.sync_losses or got.table_errors)
    media = transport.mux(bytes(100_000))
    hole = transport.demux(media[: 188 * 40] + media[188 * 41 :])
    assert hole.continuity_errors == 1
    again = transport.demux(media[: 188 * 41] + media[188 * 40 :])
    assert again.continuity_errors == 0 and again.payload() == bytes(100_000)
    noise = transport.demux(b"noise" + media + b"tail")
    assert noise.sync_losses == 2 and noise.payload() == bytes(100_000)
    assert transport.demux(b"").units == [] and transport.demux(b"G" * 10).n_packets == 0


def test_transport_tables_over_packets_and_announced_breaks():
    body = b"".join(k.to_bytes(2, "big") + (0xE000 | 0x20 + k).to_bytes(2, "big") for k in range(1, 85))
    long = transport._section(0, 1, body)
    packets = [transport._table_packet(0, 0, long[:183]), bytes([0x47, 0, 0, 0x11]) + long[183:].ljust(184, b"\xff")]
    got = transport.demux(b"".join(packets))
    assert len(long) > 300 and len(got.programs) == 84 and got.programs[7] == 0x27 and not got.table_errors and not got.continuity_errors
    assert transport.demux(packets[0]).table_errors == 1
    skipped = transport.demux(packets[0] + packets[1][:3] + b"\x12" + packets[1][4:])
    assert skipped.continuity_errors == 1
    media = transport.mux(bytes(40_000))
    first = next(i for i in range(0, len(media), 188) if media[i + 1] & 0x1F == 1 and i > 188 * 20 and media[i + 3] & 0x20)
    cut = media[: first - 188] + media[first:]
    assert transport.demux(cut).continuity_errors == 1
    told = bytearray(cut)
    told[first - 188 + 5] |= 0x80
    assert transport.demux(bytes(told)).continuity_errors == 0


def test_languages(spark, docs):
    rng = np.random.default_rng(0)
    sounds = {"aa": "ab ba ka la".split(), "bb": "zu oz xi qu".split(), "cc": "mn nm rt tr".split()}
    rows = [(i, " ".join("".join(rng.choice(sounds[x], 3)) for _ in range(20)), x) for i in range(600) for x in [list(sounds)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify_languages(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    odd = langid.identify_languages(docs).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    by_text = {r.doc_id: r.lang_pred for r in odd if r.doc_id is not None}
    assert all((by_text[i] == "und") == (not any(c.isalpha() for c in t or "")) for i, t in pairs(docs) if i is not None)
    assert langid.identify_languages(none(docs)).count() == 0


def test_more_languages_than_one_would_expect(spark):
    rows = [(i, f"{chr(0x4E00 + i % 300)}{chr(0x5E00 + i % 300)} " * 5, f"l{i % 300:03}") for i in range(2400)]
    got = langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id % 300:03}" for r in got if r.held_out]) > 0.9


def test_samples_are_bounded_where_ids_repeat(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("id"), F.lit("x").alias("label"))
    picked, _ = langid.stratified(rows, "label", 500, "id")
    assert langid.bounded(picked, 500).count() < 1500


def test_temperature_of_separable_rows():
    y = np.arange(90) % 3
    t = langid.fit_temperature(np.eye(3)[y] * 50.0, y)
    p = langid.softmax(np.eye(3)[y] * 50.0 / t).max(axis=1).mean()
    assert abs(p - (1 - 1 / 92)) < 1e-3
    rng = np.random.default_rng(4)
    z = rng.normal(size=(6000, 4)) * 2
    y = np.array([rng.choice(4, p=q) for q in langid.softmax(z)])
    assert abs(langid.fit_temperature(z * 5, y) - 5) < 0.4
    p = langid.softmax(z * 5 / langid.fit_temperature(z * 5, y))
    bins = np.digitize(p.max(1), [0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
    assert sum(abs((p.argmax(1) == y)[bins == b].mean() - p.max(1)[bins == b].mean()) * (bins == b).mean() for b in set(bins)) < 0.03


def test_gram_counts_do_not_depend_on_chunks(monkeypatch):
    text = "Größe und 日本語 mixed " * 50
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 37)
    assert all((a == b).all() for a, b in zip(langid.gram_counts(text), whole, strict=True))


def test_host_rules_and_ranks(spark):
    url = ["https://A.Example.org/es/1?x", "http://x.example.org/en/12", "http://x.example.org/en/2#a/b", "https://s.net", "http://b.com/de/1", "http://b.com/fr/1", "http://b.com/en/1", "no scheme", None, "://h/p", "http://c.b.com/x", "ftp://org/"]
    html = ['<a href="http://good.net/1">', None, '<a href=http://b.com/de/2>', "", "", "", "<a href='https://s.net/'>", "", "", "", "", ""]
    pages = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(zip(url, html, strict=True))], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in urlgraph.judge_pages(pages).collect()}
    assert [(got[i].host, got[i].path) for i in (0, 2, 3, 7, 8, 9)] == [("a.example.org", "/es/1"), ("x.example.org", "/en/2"), ("s.net", ""), ("", ""), ("", ""), ("h", "/p")]
    assert [got[i].rule for i in (0, 1, 2, 4, 5, 6)] == ["example.org/es/", "example.org/en/1", "org/", "com/de/", "com/fr/", None]
    assert [got[i].verdict for i in (0, 1, 2, 4, 5, 7, 8)] == ["block", "block", "allow", "block", "allow", "allow", "allow"]
    assert urlgraph.judge_pages(pages.filter("false")).count() == 0


def brute_ranks(edges, seeds, steps=400):
    """Ranks by power iteration; walks that end return to the seeds."""
    names = sorted({x for e in edges for x in e[:2]} | set(seeds))
    at = {x: i for i, x in enumerate(names)}
    m, start = np.zeros((len(names), len(names))), np.zeros(len(names))
    for a, b, w in edges:
        m[at[b], at[a]] += w
    for x, w in seeds.items():
        start[at[x]] = w / sum(seeds.values())
    ends = m.sum(0) == 0
    m = m / np.where(ends, 1, m.sum(0))
    rank = start
    for _ in range(steps):
        rank = 0.85 * (m @ rank + rank[ends].sum() * start) + 0.15 * start
    return dict(zip(names, rank.tolist(), strict=True))


def test_ranks_against_power_iteration(spark):
    rng = np.random.default_rng(5)
    edges = [(f"h{a}", f"h{b}", float(1 + (a + b) % 3)) for a, b in {(int(a), int(b)) for a, b in rng.integers(0, 12, (40, 2)) if a != b}] + [("h1", "end", 2.0)]
    seeds = {"h1": 2.0, "h2": 1.0, "far": 1.0}
    rows = spark.createDataFrame(edges, "src string, dst string, weight double").withColumn("kind", F.lit("x"))
    got = {r.host: r.rank for r in urlgraph.ranks(rows, spark.createDataFrame([("x", h, w) for h, w in seeds.items()], "kind string, host string, weight double"), tolerance=1e-9).collect()}
    assert all(abs(got.get(n, 0) - r) < 1e-7 for n, r in brute_ranks(edges, seeds).items())


def test_hosts_are_judged_by_links(spark):
    rng = np.random.default_rng(6)
    hosts = ["good.org", "a.net", "b.net", "c.net", "d.io", "e.io", "bad.com", "f.co"]
    rows = []
    for i in range(60):
        h = hosts[int(rng.integers(len(hosts)))]
        to = [hosts[int(k)] for k in rng.integers(0, len(hosts), 3)]
        path = "/de/x" if h == "bad.com" else "/en/y"
        rows.append((i, f"http://{h}{path}", "".join(f'<a href="{"http:" if k else ""}//{t}/1"><img src=//{t}/2>' for k, t in enumerate(to))))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    weights, seeds = Counter(), {"allow": Counter(), "block": Counter()}
    for _, url, html in rows:
        own = url.split("/")[2]
        weights.update((own, t) for t in set(re.findall(r"//([^/]+)/", html)) if t != own)
        if own == "good.org":
            seeds["allow"][own] += 1
        if own == "bad.com":
            seeds["block"][own] += 1
    trust = brute_ranks([(a, b, w) for (a, b), w in weights.items()], seeds["allow"])
    distrust = brute_ranks([(b, a, w) for (a, b), w in weights.items()], seeds["block"])
    got = {r.host: r for r in urlgraph.judge_hosts(pages).collect()}
    assert set(got) == set(trust) | set(distrust) and {r.verdict for r in got.values()} == {"allow", "block"}
    for h, r in got.items():
        assert abs(r.trust - trust.get(h, 0)) < 1e-3 and abs(r.distrust - distrust.get(h, 0)) < 1e-3
        assert (r.verdict == "block") == (distrust.get(h, 0) > trust.get(h, 0))


def brute_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = Counter(b for g in grams for h in [xxhash.xxh64_intdigest(g, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(grams))


def brute_components(prints):
    near = lambda a, b: (a ^ b).bit_count() <= 4
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if near(prints[i], prints[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(docs):
    rows = sorted(pairs(docs), key=lambda r: (r[0] is None, r[0]))
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(prints)
    least = {c: min((i for (i, _), x in zip(rows, roots, strict=True) if x == c and i is not None), default=None) for c in set(roots)}
    want = [(i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, roots, strict=True)]
    assert key(map(tuple, simhash.near_duplicates(docs).collect())) == key(want)
    assert simhash.near_duplicates(none(docs)).count() == 0


def test_links_keep_every_component(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base[:12].tolist():  # chains and dense clusters
        x = b
        for _ in range(int(rng.integers(1, 60))):
            x ^= sum(1 << int(k) for k in rng.choice(64, int(rng.integers(1, 6)), replace=False))
            prints.add(x)
            if rng.random() < 0.6:
                x = b
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.link_fingerprints(nodes)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    want = brute_components(prints)
    group = defaultdict(set)
    for p, s, c in zip(prints, signed, want, strict=True):
        group[c].add(got.get(s, s))
    assert all(len(v) == 1 for v in group.values()) and len(set().union(*group.values())) == len(group)
    a, b = simhash.spanning_links(np.array(prints, np.uint64))
    assert len(a) == len(prints) - len(set(want)) and (np.bitwise_count(a ^ b) <= 4).all()


def brute_similar(texts):
    def grams(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            p, q = sets[i], sets[j]
            if (not p and not q) or p and q and len(p & q) >= 0.8 * len(p | q):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(rng, words, share):
    return [w if rng.random() > share else f"new{rng.integers(1 << 30)}" for w in words]


def test_similar_rows(spark):
    rng = np.random.default_rng(21)
    some = [*texts(), None, "  ", "one two", "one two", "one two three"]
    for _ in range(12):  # families, chains and near misses around the least similarity
        base = [f"w{rng.integers(4000)}" for _ in range(int(rng.integers(40, 400)))]
        for _ in range(12):
            some.append(" ".join(edited(rng, base, rng.choice([0.005, 0.02, 0.03, 0.06]))))
            if rng.random() < 0.3:
                base = some[-1].split()
    some.append(" ".join(f"long{i % 3000}x{i}" for i in range(80_000)))
    some.append(some[-1] + " and more")
    rows = spark.createDataFrame(list(enumerate(some)), "at long, text string")
    want = brute_similar(some)
    assert 20 < len(set(want)) < len(some) - 80
    assert {r["at"]: r.root for r in simhash.similar_rows(rows).collect()} == dict(enumerate(want))
    assert simhash.similar_rows(rows.filter("false")).count() == 0


def test_texts_of_pairs_that_cannot_be_similar_are_not_read(spark, monkeypatch):
    rng, own, tested = np.random.default_rng(5), simhash.verified, []
    base = [f"w{rng.integers(4000)}" for _ in range(300)]
    some = [" ".join(edited(rng, base, 0.028)) for _ in range(50)]  # 1,225 pairs of about 0.6
    some += [x + " and more" for x in some[:5]]

    def counted(pairs, *more):
        tested.append(pairs.count())
        return own(pairs, *more)

    monkeypatch.setattr(simhash, "verified", counted)
    got = {r["at"]: r.root for r in simhash.similar_rows(spark.createDataFrame(list(enumerate(some)), "at long, text string")).collect()}
    assert got == dict(enumerate(brute_similar(some)))
    assert sum(tested) < 200


def test_no_similar_pair_is_beyond_its_bound():
    rng, sets = np.random.default_rng(6), []
    for n in (1, 2, 5, 40, 400, 5000, 70_000):
        base = rng.integers(0, 1 << 64, n, np.uint64)
        for share in (0, 0.05, 0.1, 0.11, 0.12, 0.2, 0.5):
            sets.append(np.unique(np.where(rng.random(n) < share, rng.integers(0, 1 << 64, n, np.uint64), base)))
    counts = np.frombuffer(b"".join(map(simhash.range_counts, sets)), np.uint8).reshape(len(sets), -1)
    assert counts.any(axis=1).tolist() == [len(s) < 70_000 - 7 for s in sets]
    i, j = np.triu_indices(len(sets), 1)
    both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    sizes = np.array([len(s) for s in sets])
    similar = both >= 0.8 * (sizes[i] + sizes[j] - both)
    may = simhash.may_be_similar(counts, counts.sum(axis=1, dtype=np.int64), i, j, 0.8)
    assert similar.sum() > 30 and may[similar].all() and (~may).sum() > 300


def test_untested_pairs_are_all_found_in_the_end():
    rng = np.random.default_rng(8)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fp[100:200] = fp[0] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    node, root = np.arange(300), np.arange(300) // 3
    a, b, more = simhash.untested_pairs(node, fp, root, 1 << 20)
    got = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
    big = np.bincount(root).argmax()
    near = {(i, j) for i in range(300) for j in range(i + 1, 300) if root[i] != root[j] and int(fp[i] ^ fp[j]).bit_count() <= simhash.WIDE}
    assert got == near and not more and big >= 0
    a, b, more = simhash.untested_pairs(node, fp, root, 2)
    assert more and len(a) <= 600


def test_one_key_of_many_fingerprints():
    rng = np.random.default_rng(3)
    keys = np.repeat(np.arange(4), [1, 2, 9, 1])
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(k), pa.array(k)], ["key", "node", "fp"]) for k in np.split(keys, [1, 2, 5, 6, 12])]
    assert [k for b in simhash._shared_keys(batches) for k in b.column(0).to_pylist()] == [1] * 2 + [2] * 9
    fp = rng.integers(0, 1 << 37, 20_000, dtype=np.uint64)  # all share 27 bits
    a, b = simhash.spanning_links(fp)
    assert (np.bitwise_count(a ^ b) <= 4).all()


def unigram():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = piece_lattice.rank_score(p.score)
    out = sentencepiece.SentencePieceProcessor()
    out.LoadFromSerializedProto(proto.SerializeToString())
    return out


@pytest.mark.parametrize("chunk", [None, 500])
def test_pieces(docs, monkeypatch, chunk):
    model = tokenizer_path("piece_bpe_32k.model")
    got = piece_lattice.encode(docs, model, ["doc_id", "text"])
    lib = unigram()
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == lib.encode(r.text or ""), r.text
    back = {(r.doc_id, r.text) for r in piece_lattice.decode(got.select("doc_id", "ids"), model, ["doc_id"]).collect()}
    assert back == {(i, t or "") for i, t in pairs(docs)}
    assert all(r.lossless for r in piece_lattice.encoding_digest(docs, model).collect())
    assert piece_lattice.encode(none(docs), model, ["doc_id"]).count() == 0


def exploded(df) -> int:
    """Rows that the plan of ``df``, which was collected, exploded."""

    def visit(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return visit(node.plan())
        own = node.metrics().apply("numOutputRows").value() if kind == "GenerateExec" else 0
        return own + sum(visit(node.children().apply(i)) for i in range(node.children().size()))

    return visit(df._jdf.queryExecution().executedPlan())


def test_pieces_of_many_rare_words(spark):
    rng, parts = random.Random(5), ["the", "ion", "ä", "cióne", "ver", "ß", "zu", "qu"]
    words = [" ".join("".join(rng.choices(parts, k=6)) for _ in range(50)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").coalesce(1)
    got, lib = piece_lattice.encode(df, tokenizer_path("piece_bpe_32k.model"), ["doc_id"]), unigram()
    assert {r.doc_id: r.ids for r in got.collect()} == {i: lib.encode(t) for i, t in enumerate(words)}
    assert 0 < exploded(got) < sum(map(len, words)) / 2  # a chunk's words share their substrings


def test_pieces_of_long_words_and_large_numbers(spark):
    text = "".join(random.Random(7).choices("theiongß", k=3000))
    df = spark.createDataFrame([(1, text), (2, None), (3, "x" * 256), (4, "y" * 257 + " z")], "doc_id long, text string")
    lib = unigram()
    for r in piece_lattice.encode(df, tokenizer_path("piece_bpe_32k.model"), ["doc_id", "text"]).collect():
        assert r.ids == lib.encode(r.text or "")
    refs = np.array([0, 70_000, 65_534, 65_535, 3, 65_536], np.int32)
    assert piece_lattice._unpacked(b"??" + piece_lattice._packed(refs), 2, len(refs)).tolist() == refs.tolist()


def test_quality(spark, docs):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(500):
        good = i % 3 > 0
        words = [str(w) + ("" if good else "&&&") for w in rng.choice(WORDS, 40)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.score_quality(df, lab).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.97
    odd = quality.score_quality(docs, lab).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in quality.score_quality(docs, lab.filter("false")).collect()} == {0.5}
    assert quality.score_quality(none(docs), lab).count() == 0
