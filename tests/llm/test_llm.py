"""The training-data operators against brute force, the public tokenizers, and odd inputs."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewell.llm import byte_bpe, chat_format, html_text, line_dedup, minhash_dedup, order_minhash, packing, quality_classifier, quality_rules, registry, substring_dedup
from tracewell.llm.pretokens import pieces

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "a b", "a b c", "Ä ö　x\x1cy", "x² Ⅷ ½ 12_3", "the " * 5000, "word" * 9000, "a b c", "a b c\n d", "'re it's WE'LL 's", "日本語 テキスト 123 😀😀", "q" * 300]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + [rows[5]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1


def brute_counts(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines, earlier, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in earlier
            earlier.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_counts(spark, docs, odd, empty):
    for df in (docs, odd):
        texts = [r.text for r in df.collect()]
        got = quality_rules.quality_rules(df).collect()
        assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter(map(brute_counts, texts))
        for r in got:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_bands_reject_repeats_and_noise():
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    rng = random.Random(1)
    noise = bytes(rng.choice(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(9000))
    assert not quality_rules.compression(noise, z)[3]
    assert not quality_rules.compression(b"buy this now " * 700, z)[3]


def test_quality_keeps_good(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = quality_rules.quality_rules(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r.quality: r.share for r in got}
    assert share[1] > 0.97


# 2


def test_bpe_is_the_librarys(spark, docs, odd, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, odd):
        got = byte_bpe.encode_documents(df, path, P.PATTERN, with_ids=True).collect()
        texts = [r.text or "" for r in df.collect()]
        want = Counter((len(i := enc.encode_ordinary(t)), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts)
        assert Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
        for bounds in ({"block_chars": 3000}, {"block_words": 1}):
            again = byte_bpe.encode_by_words(df, path, P.PATTERN, **bounds)
            assert again.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            assert Counter(map(tuple, again.collect())) == Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got)
    assert byte_bpe.encode_documents(empty, path, P.PATTERN).count() == 0
    assert byte_bpe.encode_by_words(empty, path, P.PATTERN).count() == 0


def test_bpe_blocks_meet_at_words(spark):
    """A word of all blocks is folded once; words on either side of the bound for long ones; ids of any type."""
    path = P.path("byte_bpe_multi_50k.tiktoken")
    texts = [" zqxjkvbp" + "w" * n for n in (0, 1, 118, 119, 120, 500)] + [" ñqxjzk" * 3, "ü" * 64, "ü" * 65]
    rows = [(f"id{i}", texts[i % len(texts)] + " zqxjkvbp") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = byte_bpe.encode_by_words(df, path, P.PATTERN, block_chars=100)
    want = byte_bpe.encode_documents(df, path, P.PATTERN)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(block") == 1  # documents stay where they are
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pieces_keep_to_their_pattern():
    assert pieces("ab 12", r"\p{L}") == ["a", "b"]


def test_bpe_fold_in_spark(spark, docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    some = sorted({w for r in docs.limit(20).collect() for w in pieces(r.text, P.PATTERN)}) + ["", " ", "é", "aaaa", "zzzzqqq", "日本語", "😀😀", None, "é"]
    table = spark.createDataFrame([(w, w) for w in some], "word string, ids string")
    tokens = F.from_json(F.lit(json.dumps([t.hex() for t, _ in sorted(ranks.items(), key=lambda x: x[1])])), "array<string>")
    got = byte_bpe.fold_words(table, ranks).withColumn("back", byte_bpe.join_pieces(F.col("ids"), tokens)).collect()
    assert Counter(r.word for r in got) == Counter(set(some) - {None})
    for r in got:
        assert tuple(r.ids) == (byte_bpe.fold_merges(r.word.encode(), ranks) if r.word else ()) and bytes(r.back) == r.word.encode()
    assert byte_bpe.fold_words(table.limit(0), ranks).count() == 0


def test_fold_long_equals_short():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    rng = random.Random(3)
    for _ in range(40):
        word = bytes(rng.choice(b"abcdeou") for _ in range(rng.randint(2, 90)))
        if word not in ranks:
            assert byte_bpe._fold_long(word, ranks) == byte_bpe.fold_merges(word, ranks)


def test_pieces_match_the_pattern():
    import regex

    exact = regex.compile(P.PATTERN)
    rng = random.Random(5)
    alphabet = "ab Z'srelvmd 12²Ⅷ_-é́ 　 \n\t\x1c\x85日😀½"
    for _ in range(500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pieces(t, P.PATTERN) == exact.findall(t), repr(t)


# 3


def test_classifier(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    weights = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, weights)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    bad, good = [r.score for r in rows if r.quality == 0], [r.score for r in rows if r.quality == 1]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.8 and np.mean([r.predicted == r.quality for r in rows]) > 0.9
    for r in got.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    assert quality_classifier.score(odd, weights).count() == odd.count()
    assert quality_classifier.keep_good(odd, weights).columns == odd.columns
    nothing = quality_classifier.train(empty, labels)
    assert [r.score for r in quality_classifier.score(odd, nothing).collect()] == [0.5] * odd.count()
    assert quality_classifier.score(empty, weights).count() == 0


# 4


def sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k=3, percent=85):
    s = {r.doc_id: sets(r.text, k) for r in rows}
    ids, root = sorted(s), {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = s[a], s[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    lo, hi = sorted((find(a), find(b)))
                    root[hi] = lo
    return {i: (len(s[i]), find(i)) for i in ids}


def varied(seed, n, base_words=120):
    """A group of texts, each an edit of one of those before it."""
    rng = random.Random(seed)
    out = [[f"w{rng.randint(0, 5000)}" for _ in range(base_words)]]
    for _ in range(n - 1):
        w = list(rng.choice(out[: max(1, len(out) // 3)]))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        out.append(w)
    return [" ".join(w) for w in out]


def test_near_duplicates(spark, docs, odd, empty):
    texts = varied(1, 90) + varied(2, 40, 30) + ["one two", "One TWO", "three", ""]
    group = spark.createDataFrame([(i * 7 % 997, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for df in (docs, group):
        got = minhash_dedup.near_duplicates(df).collect()
        want = brute_components(df.collect())
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash_dedup.near_duplicates(odd).count() == odd.count()
    assert minhash_dedup.near_duplicates(empty).count() == 0
    assert minhash_dedup.keep_one_each(odd).columns == odd.columns
    clash = spark.createDataFrame([(1, "a b c d e f g", 1), (2, "a b c d e f g", 2), (3, None, 3)], "doc_id long, text string, kept_id long").withColumn("__kept", F.lit(1))
    assert sorted(r.doc_id for r in minhash_dedup.keep_one_each(clash).collect()) == [1, 3]


@pytest.mark.parametrize("k, percent, bands, rows", [(3, 85, 26, 5), (5, 80, 32, 4)])
def test_near_duplicates_whole_table(spark, k, percent, bands, rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = minhash_dedup.near_duplicates(docs, k=k, percent=percent, bands=bands, rows=rows).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs.collect(), k, percent)


def test_near_duplicates_ids_with_several_texts(spark):
    """20 ids with two unlike texts each, and a near copy of either text under an id of its own: one group of three ids each."""
    rng, rows = random.Random(8), []
    for i in range(20):
        one, two = ([f"w{rng.randint(0, 10**6)}" for _ in range(80)] for _ in range(2))
        rows += [(10 * i + 5, " ".join(one)), (10 * i + 5, " ".join(two)), (10 * i + 7, " ".join(one[:-1])), (10 * i + 2, " ".join(two[1:]))]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 80 and all(r.component_id == r.doc_id // 10 * 10 + 2 for r in got)
    assert sorted(r.doc_id for r in got if r.kept) == [10 * i + 2 for i in range(20)]


# 5


def brute_repeats(rows, window=20):
    seen, gone, out = {}, {}, {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        w = words(r.text)
        cut = set()
        for i in range(len(w) - window + 1):
            t = tuple(w[i : i + window])
            if t in seen:
                cut.update(range(i, i + window))
            else:
                seen[t] = True
        out[r.doc_id] = (len(w), len(cut), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in cut).encode()).hexdigest())
    return out


def test_substring_dedup(spark, docs, odd, empty):
    shared = " ".join(f"p{i}" for i in range(25))
    rng = random.Random(4)
    rows = []
    for i in range(120):
        own = [f"v{rng.randint(0, 9)}" for _ in range(rng.randint(0, 80))]
        own[rng.randint(0, len(own)) : 0] = shared.split()[rng.randint(0, 6) :] if i % 3 else []
        rows.append((i, " \n".join(own)))
    rows.append((500, "la " * 3000))
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for df in (docs, made):
        got = substring_dedup.substring_dedup(df, digest=True).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_repeats(df.collect())
        cut = {r.doc_id: words(r.text) for r in substring_dedup.substring_dedup(df).collect()}
        assert all(hashlib.sha256(" ".join(cut[r.doc_id]).encode()).hexdigest() == r.kept_sha256 for r in got)
    clash = odd.withColumn("ref", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("span_id", F.lit(None).cast("long")).withColumn("c0", F.lit(2))
    out = substring_dedup.substring_dedup(clash)
    assert out.columns == clash.columns
    assert sorted(str(r.text) for r in out.collect()) == sorted("the" if t and t.startswith("the the") else str(t) for t in ODD + [ODD[5]])
    assert substring_dedup.substring_dedup(empty, digest=True).count() == 0


def test_substring_dedup_compares_words(spark):
    """Rows that meet on a key are repeats by their words alone."""
    said = [" ".join(f"{x}{i}" for i in range(20)).encode() for x in "aab"]
    rows = [(9, d, 1, 0, w, 1) for d, w in enumerate(said)] + [(8, 7, 1, 5, None, 3)]
    df = spark.createDataFrame([(k, d, r, s, w if w is None else bytearray(w), n) for k, d, r, s, w, n in rows], "key long, doc_id long, ref long, start int, words binary, windows int")
    assert sorted(map(tuple, substring_dedup.repeats(df).collect())) == [(1, 1, 0, 20), (7, 1, 5, 27)]


def test_substring_dedup_hot_anchors(spark, monkeypatch):
    """A phrase in many unlike surroundings, and repeats among these, by single windows."""
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    rng, rows = random.Random(9), []
    phrase = [f"h{i}" for i in range(9)]
    for i in range(300):
        own = [f"v{rng.randint(0, 10**6)}" for _ in range(60)]
        if rows and i % 3 == 0:
            own = words(rng.choice(rows)[1])
            own[rng.randint(0, 20)] = "changed"
        else:
            own[30:30] = phrase
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = substring_dedup.substring_dedup(df, digest=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_repeats(df.collect())


def test_substring_dedup_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = substring_dedup.substring_dedup(docs, digest=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_repeats(docs.collect())


# 6


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy &amp; save</div><aside>Side</aside>
<article><header><h1>Caf&eacute; &amp;  more</h1></header><p><b>First   paragraph with <a href=x>a link</a> in it.<br>And a line.<p>Yes.</p><p>Third paragraph, a longer one, with enough text to count.</p>
<form><input><button>Send</button></form><div class="comments"><p>Reader: nice</p></div></article><footer>&copy; me</footer>"""


def test_html(spark, empty):
    want = "Café & more First paragraph with a link in it. And a line. Yes. Third paragraph, a longer one, with enough text to count."
    assert html_text.main_text(PAGE) == want
    plain = "<body><div><p>" + "Long text here. " * 20 + "</p><p>Short.</p><p>" + "More text there. " * 20 + "</p></div><div class=menu>a</div>"
    assert html_text.main_text(plain).startswith("Long text") and "Short." in html_text.main_text(plain)
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (5, "u", "just text &lt;b"), (None, "u", "<<<>>> &#x41; <p <div")]
    got = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got}[1] == want and {r.page_id: r.text for r in got}[5] == "just text <b"
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == 6
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for r, p in zip(html_text.extract_main_text(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        import html as h

        inner = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<(?!/?p|/?h1|br)[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r.text == " ".join(b for b in blocks if b)
    source = spark.createDataFrame([(1, "u", PAGE, "clash", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert [r.text for r in html_text.extract_main_text(source).collect()] == [want]
    nothing = html_text.extract_main_text(source.limit(0))
    assert nothing.columns == ["page_id", "url", "text", "n_chars"] and nothing.count() == 0


def plain_page(seed):
    """A page of divs without telling names or an article element: links, a heading and long paragraphs with short ones, more links."""
    rng = random.Random(seed)
    said = lambda n: " ".join(f"{x}{rng.randint(0, 999)}" for x in rng.choices(["word", "in", "sentences", "so"], k=n))
    links = lambda n: "<div>" + "".join(f"<div><a href=x>{said(1)}</a></div>" for _ in range(n)) + "</div>"
    blocks = [said(5), *(said(rng.choice([4, 60, 90, 120])) for _ in range(8)), said(100)]
    blocks[1] = said(110)
    half = rng.randint(3, 7)
    body = "".join(f"<p>{b}</p>" for b in blocks[1:half]) + "</div><div>" + "".join(f"<p>{b}</p>" for b in blocks[half:])
    return f"<html><body>{links(8)}<div>{said(2)}</div><div><div><h1>{blocks[0]}</h1>{body}</div></div>{links(9)}<div>{said(3)}</div></body></html>", " ".join(blocks)


def test_html_threshold_selects(monkeypatch):
    """Without an article element the dense lines decide; ablated, the links come in."""
    pages = [plain_page(i) for i in range(40)]
    assert [html_text.main_text(h) for h, _ in pages] == [want for _, want in pages]
    monkeypatch.setattr(html_text, "dense_lines", lambda lines: [True] * len(lines))
    assert all(html_text.main_text(h) != want for h, want in pages)
    sections = "<div><div><p>" + "x y " * 250 + "</p></div><div><p>short last section</p></div></div>"
    assert html_text.main_text(sections).endswith("x y short last section")


def test_html_depth():
    """100,000 nested elements take seconds."""
    import time

    began = time.time()
    for one in ("<div>a", "<b>a", "<span>a</i>", "<li><b>a", "<p><i>"):
        assert len(html_text.main_text(one * 100_000)) >= 0
    assert len(html_text.main_text("<b>" * 100_000 + "<p>x</p>" * 100_000)) > 100_000
    assert len(html_text.main_text("<p>" + "word " * 500_000)) == 2_499_999
    assert time.time() - began < 60


# 7


def template(line):
    tokens = re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").split(" ")
    return (len(tokens), *("<*>" if re.search(r"[0-9@/]", t) else t for t in tokens)) if len(tokens) >= 3 else None


def test_line_dedup(spark, docs, odd, empty):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        own = [f"{rng.random():.8f}".replace("0.", "z").translate(str.maketrans("0123456789", "abcdefghij")) + f" some own line {chr(97 + i % 26)}{chr(97 + i // 26)}" for _ in range(4)]
        rows.append((i, "\n".join([own[0], f"Posted on {i} at site {i}", "", own[1], "ok", own[2]])))
    copies = [(1000 + i, rows[0][1].replace("Posted", "Sent")) for i in range(80)]
    df = spark.createDataFrame(rows + copies, "doc_id long, text string").withColumn("gone", F.lit("clash"))
    got = {r.doc_id: r for r in line_dedup.drop_template_lines(df, counts=True).collect()}
    seen = 0
    for i, text in rows:
        kept = got[i].text
        seen += "Posted" in kept
        assert kept.replace(f"Posted on {i} at site {i}\n", "") == text.replace(f"Posted on {i} at site {i}\n", "") and got[i].gone == "clash"
    assert seen == 1 and "Posted" in got[0].text  # the first stays
    assert all(got[i].text == t and got[i].n_dropped == 0 for i, t in copies)  # copies are one family
    # against brute force where each document is a family: distinct texts, families told apart by an own line
    least = 3
    out = {r.doc_id: r.text for r in line_dedup.drop_template_lines(docs, min_families=least).collect()}
    fam = {r.doc_id: r.f for r in docs.select("doc_id", F.array_min(line_dedup.template_paths(F.split("text", "\n", -1))).alias("f")).collect()}
    body = {r.doc_id: r.b for r in docs.select("doc_id", F.xxhash64("text").alias("b")).collect()}
    where = {}
    for r in docs.collect():
        for n, line in enumerate(r.text.split("\n")):
            if t := template(line):
                where.setdefault(t, []).append((r.doc_id, body[r.doc_id], n))
    drop = {x for places in where.values() if len({fam[d] for d, _, _ in places}) >= least for x in sorted(places)[1:]}
    assert drop
    for r in docs.collect():
        assert out[r.doc_id] == "\n".join(line for n, line in enumerate(r.text.split("\n")) if (r.doc_id, body[r.doc_id], n) not in drop)
    assert sorted(str(r.text) for r in line_dedup.drop_template_lines(odd).collect()) == sorted(str(t) for t in ODD + [ODD[5]])
    assert line_dedup.drop_template_lines(odd).columns == odd.columns
    assert line_dedup.drop_template_lines(empty).count() == 0


def unlike(seed, n, boilerplate):
    """n documents of three own lines each, with the lines of boilerplate between them."""
    rng = random.Random(seed)
    own = lambda: " ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(6))
    return ["\n".join([own(), *boilerplate, own(), own()]) for _ in range(n)]


@pytest.mark.parametrize("n", [20, 100])
def test_line_dedup_families(spark, n):
    rows = []
    for seed in range(8):  # other texts, other hashes
        rows += unlike(seed, n, [f"Shared {chr(97 + seed)} {x}" for x in ("one stands here", "second one stands here", "third of them is longer", "fourth line with more words than others")])
    near = unlike(99, 1, ["first part of it", "second part of it", "third part of it", *(f"part {x} of it all" for x in "abcdefghijklmnop")])[0].split("\n")
    copies = ["\n".join(f"changed {chr(97 + i % 26)}{chr(97 + i // 26)} line here" if j == i % len(near) else x for j, x in enumerate(near)) for i in range(90)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows + copies)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(df, counts=True).collect()}
    for i, text in enumerate(rows):
        want = text if i % n == 0 else "\n".join(x for x in text.split("\n") if not x.startswith("Shared"))  # the first stays
        assert got[i].text == want and got[i].n_dropped == (4 if i % n else 0)
    # 90 near copies, a line changed in each, are few families
    assert all(got[i].text == t for i, t in enumerate(copies, len(rows)))


def test_line_dedup_short_lines(spark):
    rows = unlike(1, 120, ["Read more", "Share", "", "7", "12 34"]) + unlike(2, 60, ["Next page"]) + [x.replace("<n>", str(i)) for i, x in enumerate(unlike(3, 200, ["<n>", "Page <n>"]))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.drop_recurring_lines(df).collect()}
    for x in ("Read more", "Share", "7", "12 34"):  # in 120 texts, of 100 that two tokens need
        assert [i for i, t in got.items() if x in t and i < 120] == [0]
    assert all("" in got[i] for i in range(120))  # blank lines stay
    assert all("Next page" in got[i] for i in range(120, 180))  # 60 are too few
    assert all(str(i) in got[180 + i] for i in range(200) if i != 7)  # numbers alone have nothing in common
    assert [i for i in range(200) if f"Page {i}" in got[180 + i]] == [0]


def test_line_dedup_fields_without_digits(spark):
    names = ["Anna", "Boris", "Carla", "Dmitri", "Elif", "Farid", "Greta"]
    letters = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    plain = [f"Posted by N{letters(i)} L{letters(i * 7)} in {('Sports', 'News', 'Arts')[i % 3]}" for i in range(70)]  # names of one text each
    often = [f"Written by {names[i % 7]} Q{letters(i % 30)} for the {('web', 'print')[i % 2]} edition" for i in range(210)]  # names of 30 texts, 30 last names
    prose = [f"It was a{letters(i)} b{letters(i)} c{letters(i)} d{letters(i)}" for i in range(60)]  # shares two words only
    lines = plain + often + prose
    rows = [t.replace("<x>", x) for t, x in zip(unlike(7, len(lines), ["<x>"]), lines, strict=True)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(df, counts=True).collect()}
    stays = [i for i, x in enumerate(lines) if x in got[i].text.split("\n")]
    assert stays == [0, 70, *range(280, 340)]
    assert all(got[i].n_dropped == (i not in stays) for i in range(len(lines)))


# 8


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "more"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "other"),
        (5, 0, "user", None), (6, 0, "user", ""), (7, 0, None, "x"), (None, 0, "user", "lost"), (8, None, "user", "early"), (8, 1, "assistant", "late"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chat", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert set(got) == {2, 4, 5, 6, 7, 8, None}
    assert got[2].n_copies == 2 and got[2].n_turns == 3
    assert got[2].chat == "<|user|>\nhi\n<|assistant|>\nyo\n<|user|>\nmore\n"
    assert got[8].chat.startswith("<|user|>\nearly")
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chats_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    want = con.execute(registry.CHAT_SQL).fetchall()
    assert sorted(map(tuple, registry.op8_chat_format(spark, SMALL).collect())) == sorted(want)


# 9


def test_order_minhash(spark, docs, odd, empty):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in order_minhash.neighbour_fingerprints(docs, ranges=3).collect()}
    prints = {r.doc_id: r.fingerprint for r in order_minhash.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    closer = 0
    for r, n in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + n.text[:half]
        g = got[r.doc_id]
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.fingerprint == prints[r.doc_id]
        a, b, c = (order_minhash.sketch(t) for t in (r.text, edited, n.text))
        assert g.edited_fingerprint == order_minhash.as_text(b)
        assert (g.near_edited, g.near_next) == (order_minhash.likeness(a, b), order_minhash.likeness(a, c))
        closer += g.near_edited > g.near_next or r.text == n.text
    assert closer > 0.95 * len(rows)
    assert order_minhash.neighbour_fingerprints(odd).count() == odd.count()
    assert order_minhash.neighbour_fingerprints(empty).count() == 0
    same = order_minhash.sketch("a b c d e f")
    assert order_minhash.likeness(same, same) == 1.0 and order_minhash.likeness(same, order_minhash.sketch("")) == 0.0
    assert (order_minhash.sketch("a b c d e f g h") != order_minhash.sketch("h g f e d c b a")).any()
    lone = order_minhash.neighbour_fingerprints(docs.where("doc_id = 7")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0


def test_order_minhash_is_alike_at_all_lengths(spark):
    text = [f"word{i}" for i in range(70)]
    for n in range(1, 61):
        near = order_minhash.likeness(order_minhash.sketch(" ".join(text[:n])), order_minhash.sketch(" ".join(text[: n + 1])))
        assert near > (0.1 if n < 3 else 0.5 if n < 8 else 0.75)
    for half in ("a b c d e f g h i j k l m n o p " * 4, "longerwords " * 60):
        rows = [(1, " ".join(text[:23])), (2, half)]
        got = {r.doc_id: r for r in order_minhash.neighbour_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[1].near_edited > 0
    # texts without anything in common stay apart
    assert order_minhash.likeness(order_minhash.sketch("a b c d"), order_minhash.sketch(" ".join(text))) == 0.0


def test_order_minhash_by_brute_force():
    """The method in plain Python: all k-mers sorted for each function."""
    full = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & full
        return x ^ (x >> 31)

    def numbered(units, k):
        seen, out = Counter(), []
        for i in range(max(1, len(units) - k + 1)):
            h = 0
            for j, u in enumerate(units[i : i + k]):
                h = mix(h + 0x9E3779B97F4A7C15 & full) ^ (u * (2 * j + 0x5851F42D4C957F2D) & full)
            out.append(mix(h + seen[h] * 0xD6E8FEB86659FD93 & full))
            seen[h] += 1
        return out

    rng = random.Random(5)
    for text in ["one", "a a a a a a", "x y", *(" ".join(rng.choices(["ab", "cde", "é", "日本"], k=n)) for n in (3, 23, 24, 60))]:
        by_words = numbered([xxhash.xxh3_64_intdigest(w.encode()) for w in text.split()], 2)
        by_chars = numbered([c * 0x9E3779B97F4A7C15 & full for c in [0x110000] * 4 + [ord(c) for c in text] + [0x110000] * 4], 5)
        seeds = [mix(i * 0x9E3779B97F4A7C15 & full) for i in range(1, 129)]
        for f, got in enumerate(order_minhash.sketch(text)):
            x = by_chars if f % 4 == 3 else by_words
            least = sorted(sorted(range(len(x)), key=lambda i: (((seeds[f] | 1) * x[i] + seeds[64 + f]) & full, i))[:2])
            one, two = (x[least[0]], x[least[1]]) if len(least) == 2 else (0, x[least[0]])
            assert got == mix((mix(one + 0x9E3779B97F4A7C15 & full) + two) & full) >> 32


# 10


def test_packing(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    lost = odd.where("doc_id is null")
    for df in (docs.where("doc_id % 4 = 0"), odd.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(lost)):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        want = {d: [*e.ids, 0] for d, e in zip(texts, tk.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
        got = packing.pack_documents(df, P.path("byte_bpe_50k.json"), P.PATTERN, block=64, part=2048).collect()
        by_doc, by_seq = {}, {}
        for r in got:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_seq.setdefault(r.sequence_id, []).append(r)
            part = np.array(want[r.doc_id][r.start : r.start + r.length], dtype="<u4")
            assert len(part) == r.length > 0 and r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(part.tobytes())
        for d, ids in want.items():
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r.start):
                assert r.start == at
                at += r.length
            assert at == len(ids)
        for rows in by_seq.values():
            at = 0
            for r in sorted(rows, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 1024
        total = sum(map(len, want.values()))
        assert len(by_seq) * 1024 - total < 1024 * (df.count() // 64 + 2)
    same = spark.createDataFrame([(1, "a long text " * 900)] * 50 + [(None, None)] * 3, "doc_id long, text string").coalesce(1).withColumn("key", F.lit("clash"))
    rows = packing.pack_documents(same, P.path("byte_bpe_50k.json"), P.PATTERN, block=4).collect()
    n = {r.doc_tokens for r in rows if r.doc_id == 1}
    assert len(n) == 1 and sum(r.length for r in rows) == 50 * n.pop() + 3  # repeated rows are documents of their own
    assert len({r.sequence_id >> 32 for r in rows}) > 10  # and not one block's
    assert packing.pack_documents(empty, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_packing_takes_long_runs_and_slices(spark, monkeypatch):
    import tiktoken
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    long = ["x" + " " * 1_000_000 + "y z", "\n" * 1_000_000]  # the matcher's stack overflows on these
    wanted = [[*tk.encode(t, add_special_tokens=False).ids, 0] for t in long]
    got = packing.tokenised(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), path, P.PATTERN, part=1 << 30).collect()
    assert [np.frombuffer(r.ids, "<u2").tolist() for r in sorted(got, key=lambda r: r.doc_id)] == wanted
    encoding = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=packing.ranks_of(path), special_tokens={})
    monkeypatch.setattr(packing, "SLICE", 1)
    for t in ["a b  c 1\n\n d's 's x\n y 2 ", *filter(None, ODD)]:
        assert "".join(packing._slices(t, P.PATTERN)) == t
        assert np.frombuffer(packing.ids_of(t, encoding, P.PATTERN), "<u2").tolist() == tk.encode(t, add_special_tokens=False).ids


def test_deal_balances_cost():
    rng = random.Random(2)
    lengths = [rng.randint(1, 1024) for _ in range(3000)]
    out = packing.deal(lengths)
    assert sum(x[2] for x in out) == sum(lengths)
    assert len({x[3] for x in out}) == -(-sum(lengths) // 1024)


# pipeline


def test_pipeline_stages(spark, odd, empty):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name == "packing":
            assert out.select("doc_id").distinct().count() == docs.count()
            break
        assert out.columns == docs.columns
        before = docs.collect()
        rows = out.collect()
        if name == "MinHash near-dedup":
            want = brute_components(before, 5, 80)
            assert {r.doc_id for r in rows} == {d for d, (_, c) in want.items() if d == c}
        if name == "substring dedup":
            want = brute_repeats(before)
            assert all(hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest() == want[r.doc_id][2] for r in rows)
        docs = spark.createDataFrame(rows, out.schema)
    for name, stage in cp.STAGES[1:]:
        assert stage(spark, empty.drop("kept"), sf).count() == 0
        assert stage(spark, odd.drop("kept"), sf).count() >= 0
    assert json.dumps([n for n, _ in cp.STAGES]) and Row
