"""Operators of ``presswork.llm`` against brute force, on small inputs with every kind of odd row."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

TEXTS = [None, "", "  \n\t", "one", "one two three four", "One TWO three four five six", "one two three four five six",
         "x" * 3000, "don't we'll 's ''s it's\t's", "é́ ÀÉ İ Σ ß × 你好 😀   ½²", "a  b\r\n\r\n  c   ",
         "!!! ??? %%% <|endoftext|> \x02 x\x02y", "word " * 4000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "x") for i, t in enumerate(TEXTS)] + [(None, "no id here", "clash", "x"), (5, TEXTS[5], "clash", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_shingles string, kept string")


def words_of(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))]


def test_near_duplicates(spark, docs):
    from presswork.llm.minhash_dedup import deduplicate, near_duplicates

    got = near_duplicates(docs).collect()
    assert len(got) == docs.count()
    of = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        w = words_of(t)
        want = len({tuple(w[k:k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else min(1, len(w))
        assert of[i].n_shingles == want
    assert of[6].component_id == 5 and not of[6].kept and of[0].component_id == 0 and of[1].kept
    assert of[None].component_id is None and of[None].kept
    assert deduplicate(docs).columns == docs.columns and deduplicate(docs).count() == docs.count() - 2  # also one of two equal rows
    assert near_duplicates(docs.limit(0)).count() == 0


def test_near_group_across_the_threshold(spark):
    import random

    from presswork.llm.minhash_dedup import near_duplicates

    rnd = random.Random(3)
    base = [f"w{rnd.randint(0, 9999)}" for _ in range(150)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rnd.choice((2, 4, 5, 6))):
            w[rnd.randrange(150)] = f"x{rnd.randint(0, 10 ** 6)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                c = len(sets[a] & sets[b])
                if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == label


def test_byte_bpe(spark, docs):
    import public_tokenizers as P
    import tiktoken

    from presswork.llm.byte_bpe import RANKS, decode, encode, round_trip

    with open(P.path(RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in round_trip(docs).collect()}
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = decode(encode(docs.withColumnRenamed("kept", "ids"), column="out"), column="out", text="again")
    assert {(r.text or "") == r.again for r in back.collect()} == {True}
    assert round_trip(docs.limit(0)).count() == 0


def test_token_files(spark, docs, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from presswork.llm.token_store import TOKENIZER, TokenFile, read_tokens, write_tokens

    tokenizer = Tokenizer.from_file(P.path(TOKENIZER))
    tokenizer.encode_special_tokens = True
    manifest = write_tokens(docs, folder=str(tmp_path / "files"))
    got = sorted(read_tokens(spark, manifest).collect(), key=lambda r: r.start)
    order = sorted([(-1, "no id here"), (5, TEXTS[5]), *enumerate(TEXTS)], key=lambda r: r[0])
    start = 0
    for row, (doc_id, text) in zip(got, order, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(row) == (None if doc_id < 0 else doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    uri = manifest.first().uri
    file = TokenFile(uri)
    all_ids = np.concatenate([ids for _, _, ids in file.documents()])
    assert (file.ids(3, 10) == all_ids[3:13]).all()
    raw = bytearray(open(uri, "rb").read())
    raw[12] ^= 0xFF
    open(uri, "wb").write(raw)
    with pytest.raises(Exception):
        list(TokenFile(uri).documents())
    assert read_tokens(spark, write_tokens(docs.limit(0))).count() == 0


def test_decontamination(spark):
    from presswork.llm.decontaminate import contamination_report, find_contamination, remove_contamination

    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame(
        [(1, "clean words only"), (2, f"before, {passage.upper()}! after"), (3, None), (4, "short item"), (2, "x")],
        "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage), (7, passage), (8, "Short-item"), (9, None), (None, "")], "item_id long, text string")
    got = sorted(contamination_report(docs, bench).collect())
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got] == [
        (1, 3, 0, 0, False), (2, 1, 0, 0, False), (2, 14, 12, 1, True), (3, 0, 0, 0, False), (4, 2, 2, 1, True)]
    blocks = find_contamination(docs, bench, block_chars=40).selectExpr("doc_id", "size(hits) as n")
    assert sorted(map(tuple, blocks.collect())) == [(1, 0), (2, 0), (2, 12), (3, 0), (4, 2)]
    assert {r.text for r in remove_contamination(docs, bench, mode="spans").filter("doc_id = 2").collect()} == {"before, ! after", "x"}
    assert remove_contamination(docs, bench).count() == 3 and contamination_report(docs, bench.limit(0)).filter("contaminated").isEmpty()


def test_quality(spark):
    from pyspark.sql import functions as F

    from presswork.llm.quality import classify, keep_good

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = classify(docs).join(labels, "doc_id").select((F.col("accepted").cast("int") == F.col("quality")).cast("int").alias("ok"))
    assert both.agg(F.avg("ok")).first()[0] > 0.95
    odd = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (None, "some fair words to keep here", 2.0)], "doc_id long, text string, probability double")
    assert [r.accepted for r in sorted(classify(odd).collect(), key=lambda r: r.doc_id or 0)][1:] == [False, False]
    assert keep_good(odd).columns == odd.columns and classify(odd.limit(0)).count() == 0


def test_secrets(spark):
    from presswork.llm.secret_scan import describe, find, fit, labelled_findings, redact

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = fit(docs, findings=1500)
    held_out = labelled_findings(sorted(model.lexicon.words), 600, seed=99)
    p = model.forest.probability(np.array([describe(t, a, b, model.lexicon) for t, a, b, _ in held_out]))
    assert ((p >= 0.5) == np.array([y for *_, y in held_out])).mean() > 0.95
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    odd = spark.createDataFrame([(1, f'the token = "{key}" of'), (2, None), (3, ""), (4, f"commit {key} done"),
                                 (None, "x " * 50_000 + f'token = "{key}"')], "doc_id long, text string")
    found = {r.doc_id: (r.start, r.n_chars) for r in find(odd, model).collect()}
    assert found[1] == (13, 40) and found[None] == (100_009, 40) and 4 not in found
    clean = redact(odd, model)
    assert clean.columns == odd.columns and clean.filter(f"text like '%{key}%'").count() == 1


def test_secrets_without_blanks(spark):
    from presswork.llm.secret_scan import candidates, find, fit, redact

    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    model = fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), findings=1500)
    texts = ["password=Tr0ub4dor!x9Q#kz7 end", f"API_KEY={key}", f"export token={key}\nnext", f"x; auth_token={key}; path=/",
             f"http://a.org/p?lang=en&token={key}&page=2", f"key={key}!tail%x", f"a?secret={key}&password={key}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in redact(rows, model).collect()}
    assert clean == {0: "password=[SECRET] end", 1: "API_KEY=[SECRET]", 2: "export token=[SECRET]\nnext", 3: "x; auth_token=[SECRET]; path=/",
                     4: "http://a.org/p?lang=en&token=[SECRET]&page=2", 5: "key=[SECRET]", 6: "a?secret=[SECRET]&password=[SECRET]"}
    found = {(r.doc_id, texts[r.doc_id][r.start:r.start + r.n_chars]) for r in find(rows, model).collect()}
    assert found == {(0, "Tr0ub4dor!x9Q#kz7"), (5, f"{key}!tail%x"), *((i, key) for i in (1, 2, 3, 4, 6))}
    padded = "dGhpcyBpcyBhIGxvbmcgdmFsdWU="  # '=' at the end is no assignment
    assert [padded[a:b] for a, b in candidates(padded)] == [padded]


def test_chat_format(spark):
    from pyspark.sql import functions as F

    from presswork.llm import chat_format as C

    log = [(1, 0, "message", "a", "user", "hi <\\| <|"), (1, 1, "message", "b", "assistant", "x"), (1, 2, "delta", "b", None, "y"),
           (1, 3, "regenerate", "b", None, None), (1, 4, "delta", "b", None, "new"), (1, 5, "delta", "b", None, " <|im_end|>"),
           (1, 6, "edit", "a", "user", "hello"), (2, 0, "delta", "z", "ro%le\nx", "o"), (3, 0, "message", "m", None, None),
           (3, 0, "message", "m", None, None), (None, 0, "message", "m", "user", "q")]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, msg string, role string, text string")
    out = C.render(C.reconstruct(events)).select("conv_id", C.read_back(F.col("formatted")).alias("t"), C.loss_text(F.col("segments")).alias("l"))
    got = {r.conv_id: ([tuple(x) for x in r.t], r.l) for r in out.collect()}
    assert got == {1: ([("user", "hello"), ("assistant", "new <|im_end|>")], "new <|im_end|>"), 2: ([("ro%le\nx", "o")], ""),
                   3: ([("", ""), ("", "")], ""), None: ([("user", "q")], "")}
    assert C.render(C.reconstruct(events.limit(0))).count() == 0


def test_page_text(spark):
    from presswork.llm.html_extract import extract, main_text

    page = """<html><head><title>T</title></head><body><header class="site"><h1>Site</h1></header><div id="cookie-notice">We</div>
    <main><article><header><h1>T&eacute;st &amp; co</h1></header><p>one<br>two <b>th</b>ree&nbsp;x</p><ul><li>a<li>b</ul>
    <aside>side</aside><form>f</form><section class="comments"><p>nice!</p></section></article></main>
    <div class="sidebar">s</div><!-- <p>no</p> --><script>if (a<b) "</p>"</script><footer>(c)</footer>"""
    assert main_text(page) == "Tést & co one two three x a b"
    assert main_text(None) == "" and main_text("<!-- open") == "" and main_text("plain <i>x</i>") == "plain x"
    # unnamed template text shared by all pages of a host goes, its articles stay
    rows = [(i, "http://h.org/x", f"<body><div><span>Same on all</span></div><div class=text><p>Own {i} text " + f"t{i} " * 30 + "</p></div></body>")
            for i in range(12)] + [(98, None, None), (99, "odd", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bound in (10, -1):
        got = {r.page_id: r.text for r in extract(pages, broadcast_rows=bound).collect()}
        assert len(got) == 14 and got[98] == got[99] == "" and all(got[i].startswith(f"Own {i} text") for i in range(12))


def test_page_text_of_copies(spark):
    from presswork.llm.html_extract import extract

    def article(title, i):
        return f"<h1>{title}</h1><p>{f'long text {i} ' * 40}</p><h2>Overview</h2><ul><li>first<li>second</ul><blockquote>said</blockquote>"

    # one article on all pages; own articles with common subheads; copies without an article element
    rows = [(i, "http://a.org/x", f"<body><article>{article('One', 0)}</article></body>") for i in range(20)]
    rows += [(20 + i, "http://b.org/x", f"<body><article>{article(f'T{i}', i)}</article></body>") for i in range(20)]
    rows += [(40 + i, "http://c.org/x", f"<body><div>{article('One', 0)}</div></body>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bound in (10, -1):
        got = {r.page_id: r.text for r in extract(pages, broadcast_rows=bound).collect()}
        assert len(got) == 60
        for i, text in got.items():
            own = i - 20 if 20 <= i < 40 else 0
            title = f"T{own}" if 20 <= i < 40 else "One"
            assert text == f"{title} " + f"long text {own} " * 40 + "Overview first second said"


def test_page_text_after_icons():
    from presswork.llm.html_extract import main_text

    def text(inside):
        return main_text(f"<body><article><p>one {inside} two</p><p>three</p></article></body>")

    for icon in ('<svg class="i"/>', "<math/>", "<svg><path d='M0'/><title/><text>no</text></svg>", "<svg class='i'>", "<noscript>", "<template>",
                 "<noscript><p>no</p></noscript>", "<template><b>no</b></template>", "<SVG/><svg><g/></svg>"):
        assert text(icon) == "one two three", icon
    assert text("<svg/> and <svg><title>no</title></svg>") == "one and two three"
    assert text("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>") == "one x=1 two three"
    assert main_text("<div><svg><p>kept</p></div><svg></svg><p>more</p>") == "kept more"
    assert main_text("<p>a</p><script/>x") == "a"


def test_page_text_under_names():
    from presswork.llm.html_extract import main_text

    body = "<h1>Title</h1><p>" + "some text " * 30 + "</p>"
    want = "Title " + "some text " * 29 + "some text"
    for before, after in (('<div class="content no-sidebar">', "</div>"), ('<div id="page-with-menu">', "</div>"), ("<form>", "</form>"),
                          ('<article class="post has-comments">', "</article>"), ('<div class="content-sidebar"><article>', "</article></div>"),
                          ('<form id="search"><main>', "</main></form>"), ('<article><div class="menu">', "</div></article>")):
        page = f'<body><div class="site-footer">f</div><div id="cookie-notice">c</div>{before}{body}{after}<div class="ad-box">x</div></body>'
        assert main_text(page) == want, before
    card = "<article><h3>Card</h3></article>"
    assert main_text(f"<body><div>{body}</div>{card}</body>") == want + " Card"
    assert main_text(f'<body><div>{body}</div><div class="related">{card}</div></body>') == want
    # comments of readers stay out, also where they are articles or longer than the page's own
    comments = '<div id="comments">' + "<article><p>nice page, thanks</p></article>" * 90 + "</div>"
    assert main_text(f"<body><article>{body}</article>{comments}</body>") == want
    assert main_text('<div class="menu"><p>abc</p></div><div class="sidebar"><b>abcd</b></div>') == "abcd"


def test_url_filter(spark):
    from presswork.llm.url_filter import judge

    rows = [(1, "http://A.example.NET/en/1?q"), (2, "http://x.net/de"), (3, "http://m.example.com/de/2#a"), (4, "https://w.org/fr/"),
            (5, "https://notorg/fr/"), (6, None), (7, "no scheme"), (8, "http://x.net"), (9, "http://www.cheap-pills.example.com/en/1"),
            (None, "://")] + [(100 + i, f"http://site{i % 7}.example.org/en/{i}") for i in range(60)]
    rows += [(200 + i, f"http://www.cheap-pills.example.com/en/{i}") for i in range(20)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[2] == ("x.net", "/de", "net/", "block")
    assert got[3] == ("m.example.com", "/de/2", "example.com/de/", "block") and got[4] == ("w.org", "/fr/", "org/fr/", "allow")
    assert got[5][2] is None and got[6] == ("", "", None, "allow") and got[7][:3] == ("", "", None) and got[8][2] is None
    assert got[9][2:] == (None, "block") and got[None][:3] == ("", "", None) and got[120][3] == "allow"


def test_url_scores_are_exact(spark):
    import math
    import random
    from collections import Counter

    from presswork.llm.url_filter import BETA, ORDER, fit, judge

    rnd = random.Random(5)
    urls = [f"http://{'cheap-pills' if i % 3 == 0 else 'site'}{rnd.getrandbits(60):x}.de/{rnd.getrandbits(90):x}" for i in range(4000)]
    seen, totals = (Counter(), Counter()), (Counter(), Counter())
    for i, url in [*enumerate(urls), (1, urls[1])]:
        for at in range(len(url)):
            for k in range(ORDER + 1):
                context = ("\0" * ORDER + url[:at])[-k:] if k else ""
                seen[i % 3 == 0][k, context, url[at]] += 1
                totals[i % 3 == 0][k, context] += 1
    assert len(seen[0] + seen[1]) > 1 << 17

    def wanted(url):
        out = 0.0
        for at in range(len(url)):
            p = [1 / 256, 1 / 256]
            for k in range(ORDER + 1):
                context = ("\0" * ORDER + url[:at])[-k:] if k else ""
                p = [(seen[c][k, context, url[at]] + BETA * p[c]) / (totals[c][k, context] + BETA) for c in (0, 1)]
            out += math.log(p[1] / p[0])
        return out / len(url)

    pages = spark.createDataFrame(list(enumerate(urls)) + [(9000, urls[1]), (9001, None), (9002, "")], "page_id long, url string")
    got = {r.page_id: r for r in judge(pages).collect()}
    assert len(got) == 4003 and got[9000].score == got[1].score and got[9001].score == got[9002].score == 0
    assert all(abs(got[i].score - wanted(urls[i])) < 1e-6 for i in range(0, 4000, 7))
    # by a join but for the most frequent, to the last bit
    assert {r.page_id: r for r in judge(pages, broadcast_rows=300).collect()} == got
    new = "http://other-casino.fr/x-y-z"  # with numbers that the model has not counted
    assert abs(judge(spark.createDataFrame([(1, new)], "page_id long, url string"), fit(pages)).first().score - wanted(new)) < 1e-6


def test_embeddings(spark):
    from presswork.llm.embedding_dedup import near_duplicates

    rng = np.random.default_rng(1)
    centre = rng.standard_normal(32)
    x = np.concatenate([rng.standard_normal((60, 32)), centre + rng.standard_normal((120, 32)) * rng.choice([.1, .2, .25], (120, 1))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300 + i, [float(v) for v in x[3]]) for i in range(9)]
    odd = [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [None, 1.0]), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in near_duplicates(frame, block=32).collect()}
    ids, unit = [i for i, _ in rows], np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    assert [got[i].n_links for i in ids] == linked.sum(axis=1).tolist()
    assert got[305].component_id == 3 and all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))
    assert got[906].component_id == 905 and near_duplicates(frame.limit(0)).count() == 0


def test_pipeline_and_registration(spark):
    import corpus_pipeline
    from presswork.llm.queries import queries

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "tokens"]
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 14))
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 100 < got.count() < 200
