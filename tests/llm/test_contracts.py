"""The ten operators' queries against brute force, on the small tables and on a table of awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from compare import check
from conftest import SMALL
from pyspark.sql import functions as F

from gridflux.llm import registry
from gridflux.llm.packing import tokenizer_path
from gridflux.llm.simhash import fingerprint_words

BLANK = re.compile("[\x20\x09-\x0d]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINE = "this line stands in many documents"
PROSE = " ".join(f"word{i * 7919 % 1009}" for i in range(120))
AWKWARD = [
    (1, None, "en", "web"), (2, "", "en", "web"), (3, " \t\n ", None, "web"), (4, PROSE, "en", None), (5, PROSE, "en", "web"), (5, PROSE, "en", "web"),
    (6, f"{LINE}\n{PROSE}\n{LINE.upper()}  ", "en", "web"), (7, f"short\n{LINE}\nshort\n\n", "de", "web"), (8, "a b a b a b a b " * 40, "de", "web"),
    (9, "Licensed under the MIT License; see the GNU General Public License. CC BY, Apache-License", "en", "code"), (10, "ÄÖÜ É ñandú   line\x0bfeed\rreturn 日本語", "fr", "web"),
    (11, "mit license " * 3000 + "x" * 50_000, "en", "code"), (12, "one", "en", "web"), (13, "one two", "en", "web"), (14, "!!! ... 123", "en", "web"), (None, f"no id {PROSE}", None, None), (-7, PROSE.replace("word0", "WORD0"), "en", "web"),
    (15, "x" * 9 + "\n" + "y" * 10, "en", "web"), (16, "x" * 9 + "\n " + "Y" * 10 + "\t", "en", "web"), (17, "dup\ndup\n dup \nother\n#*$%&|<>", "en", "web"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of awkward tables; extra columns bear the names that operators use inside."""
    at = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in AWKWARD], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra = {c: F.lit(3) for c in ("n", "id", "h", "k", "w", "l", "row", "lost", "fp", "score", "form", "component_id", "kept", "length", "start", "bin", "a.b", "lang_pred", "n_words", "__found")}
    docs.withColumns(extra).write.parquet(f"{at}/documents.parquet")
    pages = [(1, "http://a.org/x", "<html><body><nav>menu</nav><article><p>Main &amp; text</p></article></body></html>"), (2, "http://a.org/x", None), (3, None, ""), (4, "http://a.org/y", "<p>unclosed <b>bold"), (5, ":::", "<p>" + "long " * 50_000), (6, "http://b.org/", "<article>" + "same payload " * 20 + "</article>"), (7, "http://b.org/2", "<article>" + "same payload " * 20 + "</article>"), (7, "http://b.org/2", "<article>" + "same payload " * 20 + "</article>")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("text", "payload", "rank", "digest", "id", "host")}).write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(1, "the quick benchmark question asks which river flows through the capital"), (2, None), (None, "x"), (3, "")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 1, 1), (None, 0, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    """Empty tables."""
    at = str(tmp_path_factory.mktemp("none"))
    for name, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("pages", "page_id bigint, url string, html string"), ("benchmark", "item_id bigint, text string"), ("labels", "doc_id bigint, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.fixture(params=["small", "odd"])
def sf_dir(request, odd):
    return {"small": SMALL, "odd": odd}[request.param]


def texts(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def run(spark, name, sf_dir):
    return registry.QUERIES[name](spark, sf_dir).collect()


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables_give_no_rows(spark, none, name):
    assert run(spark, name, none) == []


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    check(registry.QUERIES[name](spark, SMALL), registry.SQL[name], SMALL)


def test_op1_base(spark, sf_dir):
    phrases = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}
    want = []
    for doc_id, text, *_ in texts(spark, sf_dir):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))
        at = [(i, label) for i in range(len(w)) for p, label in phrases.items() if tuple(w[i : i + len(p)]) == p]
        want.append((doc_id, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    got = run(spark, "op1_licenses", sf_dir)
    assert order((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == order(want)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_op2_all_links(spark, sf_dir):
    fps = []
    for doc_id, text, *_ in texts(spark, sf_dir):
        w = [x for x in BLANK.split((text or "").translate(AZ)) if x]
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append((doc_id, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                label[find(i)] = find(j)
    first = defaultdict(list)
    for i, (doc_id, _) in enumerate(fps):
        first[find(i)] += [doc_id] if doc_id is not None else []
    want = [(d, f"{fp:016x}", min(first[find(i)], default=None)) for i, (d, fp) in enumerate(fps)]
    assert order(tuple(r)[:3] for r in run(spark, "op2_simhash", sf_dir)) == order(want)


def test_op2_dense_buckets_lose_no_link(spark):
    import numpy as np

    from gridflux.llm import simhash

    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 6)]
    fps = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (40, 2))} | set(base))
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, dense=4)).collect()}
    mask = (1 << 64) - 1
    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) & mask).bit_count() <= 2:
                assert roots[a] == roots[b]
    assert len({roots.get(f, f) for f in fps}) == 6


def test_op2_chunks_do_not_matter():
    w = [f"w{i % 97}".encode() for i in range(1000)]
    assert fingerprint_words(w, 3, chunk=7) == fingerprint_words(w, 3)


def test_op3(spark, sf_dir):
    got = run(spark, "op3_toxicity", sf_dir)
    assert len(got) == len(texts(spark, sf_dir))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and (r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)) for r in got)


def test_op4_awkward_pages(spark, odd):
    got = {r.page_id: r for r in run(spark, "op4_html", odd)}
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got.values())
    assert got[1].text == "Main & text" and got[2].text == got[3].text == "" and got[4].text == "unclosed bold" and got[5].n_chars == 50_000 * 5 - 1


def extracted(spark, pages):
    from gridflux.llm import html

    return {r.page_id: r for r in html.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}


def test_op4_deletes_shared_lines_inside_articles(spark):
    story = lambda k: f"<p>{' '.join(f'story{k}word{i}' for i in range(30))}</p>"
    pages = [(k, f"http://a.org/{k}", f"<article>{story(k)}<p>Subscribe to read on</p></article>") for k in range(4)]
    got = extracted(spark, pages)
    assert all(got[k].text == story(k)[3:-4] and got[k].n_shared == 1 for k in range(4))
    copies = [(k, f"http://b.org/{k}", f"<main>{story(9)}</main>") for k in range(2)]
    assert all(r.text == story(9)[3:-4] for r in extracted(spark, copies).values())


def test_op4_short_pages_and_runs_of_copies(spark):
    menu = "<p>A long unmarked template line that stands on each page of this host and says nothing new</p>"
    pages = [(k, f"http://a.org/{k}", f"{menu}<p>news {k}</p>") for k in range(3)]
    assert {k: r.text for k, r in extracted(spark, pages).items()} == {k: f"news {k}" for k in range(3)}
    story = lambda k: " ".join(f"story{k}word{i}" for i in range(40))
    pages = [(k, f"http://a.org/{k}", f"{menu}<p>{story(0 if k < 5 else k)}</p>") for k in range(8)]
    assert {k: r.text for k, r in extracted(spark, pages).items()} == {k: story(0 if k < 5 else k) for k in range(8)}


def test_op4_long_and_unclosed_attribute_values():
    from gridflux.llm.html import DROP, OPEN, visible_lines

    big = "x" * 5000
    assert visible_lines(f'<p>a <img src="data:{big}"> b</p>') == [("a b", OPEN)]
    assert visible_lines(f"<div class='sidebar' data-x='{big}'>menu</div><script a=\"{big}\">code</script><p>t</p>") == [("menu", DROP), ("t", OPEN)]
    assert visible_lines('<p>a <b title="x>bold</b> c</p>') == [("a bold c", OPEN)]
    assert visible_lines('<p>a</p><script a="x>code</script>') == [("a", OPEN)]


def test_op5_base(spark, sf_dir):
    want = []
    for doc_id, text, *_ in texts(spark, sf_dir):
        text = text or ""
        w = [x for x in BLANK.split(text) if x]
        lines = [x for x in text.split("\n") if BLANK.sub("", x)]
        n3 = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if n3[g] > 1 for k in range(3)}
        want.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    got = run(spark, "op5_quality", sf_dir)
    assert order(tuple(r)[:7] for r in got) == order(want)
    assert not any(r.kept and r.base_failed for r in got)


def test_op6_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer

    import numpy as np

    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    want = Counter()
    ids = defaultdict(list)
    for doc_id, text, *_ in texts(spark, sf_dir):
        x = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        want[doc_id, len(x)] += len(x)
        ids[doc_id, len(x)].append(x)
    got = run(spark, "op6_packing", sf_dir)
    have, seqs = Counter(), defaultdict(list)
    for r in got:
        have[r.doc_id, r.doc_tokens] += r.length
        seqs[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 in {zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in ids[r.doc_id, r.doc_tokens]}
    assert have == want
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_op7(spark, sf_dir):
    got = run(spark, "op7_langid", sf_dir)
    truth = {d: lang for d, _, lang, _ in texts(spark, sf_dir)}
    assert len(got) == len(texts(spark, sf_dir))
    assert all(0 <= r.score <= 1 and (r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)) for r in got)
    if sf_dir == SMALL:
        held = [r for r in got if r.held_out and r.lang_pred != "und" and truth[r.doc_id]]
        assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.8 * len(held)
    else:
        assert all(r.lang_pred == "und" for r in got if r.doc_id in (1, 2, 3, 14))


def test_op8(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()]
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    first: dict = {}
    for p, h in rows:
        first[digest(h)] = min(p, first.get(digest(h), p))
    want = []
    for p, h in rows:
        size = len((h or "").encode())
        again = size >= 100 and first[digest(h)] != p
        want.append((p, size, digest(h), "revisit" if again else "response", first[digest(h)] if again else None))
    assert order((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in run(spark, "op8_warc", sf_dir)) == order(want)


def test_op9(spark, sf_dir):
    docs = texts(spark, sf_dir)
    last = 1 << 63
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(AZ)
    first: dict = {}
    for d, t, *_ in docs:
        for x in (t or "").split("\n"):
            first[key(x)] = min(first.get(key(x), last), last if d is None else d)
    want = []
    for d, t, *_ in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or first[key(x)] == (last if d is None else d)]
        want.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    assert order(tuple(r)[:4] for r in run(spark, "op9_linededup", sf_dir)) == order(want)


def test_op10_finds_every_planted_passage(spark):
    from gridflux.llm import decontaminate

    item = "the quick benchmark question asks which river flows through the old capital city of the northern province"
    edited = item.replace("quick", "quiet").replace("old capital", "od capitall")
    docs = [(1, f"before it {item} and after"), (2, f"x {edited.upper()} y"), (3, "an unrelated text about rivers and a capital city"), (4, None), (5, ""), (6, item[: len(item) // 2])]
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(9, item), (8, item), (7, None)], "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (1, 2) for i in (8, 9)}
    assert {r.doc_id: r.distance for r in got}[1] == 0 and {r.doc_id: r.distance for r in got}[2] > 0


def test_op10_equals_brute_force(spark):
    from gridflux.llm.decontaminate import plain

    def best(p, t):
        row = list(range(len(p) + 1))
        least = row[-1]
        for c in t:
            new = [0]
            for i, q in enumerate(p):
                new.append(min(row[i] + (q != c), row[i + 1] + 1, new[i] + 1))
            row, least = new, min(least, new[-1])
        return least

    docs = [r for r in texts(spark, SMALL) if r[1] and len(r[1]) < 600][:40]
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()][:12]
    want = {(d, i) for d, t, *_ in docs for i, p in items if len(p) >= 32 and best(p, plain(t)) <= max(0, len(p) // 16 - 1)}
    got = {(r.doc_id, r.item_id) for r in run(spark, "op10_decontaminate", SMALL)}
    ids, names = {d for d, *_ in docs}, {i for i, _ in items}
    assert {(d, i) for d, i in got if d in ids and i in names} == want


def test_op5_rejects_planted_outliers_of_small_and_large_groups(spark):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60, 120))), "en", "web" if i < 300 else "small") for i in range(320)]
    docs += [(1000 + i, " ".join("# $ %" if k % 2 else word() for k in range(80)), "en", "web" if i < 10 else "small") for i in range(12)]
    docs += [(2000, " ".join("x" * 200 for _ in range(60)) + " a b c", "en", "web"), (2001, docs[5][1], None, None)]
    from gridflux.llm import quality

    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not any(got[1000 + i].kept for i in range(12)) and not got[2000].kept
    assert all(got[i].kept for i in range(320)) and got[2001].kept


def test_op5_estimate_equals_numpy(spark):
    import numpy as np

    from gridflux.llm import quality

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (400, 4)), rng.normal(8, 0.2, (90, 4))])
    rows = spark.createDataFrame([("2g", *map(float, r)) for r in x], "k string, v0 double, v1 double, v2 double, v3 double")
    got = quality.mcd(rows, 0.75, 20).first()
    floors = np.diag(np.array(quality.FLOORS) ** 2)
    m, s = np.median(x, 0), np.diag((1.4826 * np.median(np.abs(x - np.median(x, 0)), 0)) ** 2) + floors
    dist = lambda m, s: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
    for _ in range(30):
        near = x[np.argsort(dist(m, s))[: int(0.75 * len(x))]]
        m, s = near.mean(0), np.cov(near.T, bias=True) * 0.75 / quality.chi2_cdf(quality.chi2_quantile(0.75, 4), 6) + floors
    inner = quality.chi2_quantile(0.975, 4)
    good = x[dist(m, s) <= inner]
    assert abs(got["n"] - len(good)) <= 8
    assert np.allclose([got[f"m{i}"] for i in range(4)], good.mean(0), atol=0.05)


def test_op10_short_items_stand_at_word_edges(spark):
    from gridflux.llm import decontaminate

    docs = spark.createDataFrame([(1, "So: what is the Capital of France?"), (2, "whatwhat is the capital of francerie"), (3, "yes")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "What is the capital of France"), (2, "yes")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id, r.distance, r.start) for r in decontaminate.matches(docs, items).collect()] == [(1, 1, 0, 3)]


def test_op10_blocks_do_not_matter_and_the_best_place_is_told(spark):
    from gridflux.llm import decontaminate

    items = [f"item {k} asks which of the {k} rivers of province number {k * 37} flows past the old mill" for k in range(6)]
    docs = [(k, f"{items[k].replace('rivers', 'rivrs')} and later {items[k]} end") for k in range(6)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    whole = order(map(tuple, decontaminate.matches(d, b).collect()))
    assert whole == order(map(tuple, decontaminate.matches(d, b, block_chars=100).collect()))
    assert all((k, k) in {r[:2] for r in whole} for k in range(6)) and all(r[2] == 0 for r in whole if r[0] == r[1])


def test_op4_names_that_only_hold_a_mark_are_not_dropped():
    from gridflux.llm.html import DROP, MAIN, visible_lines

    page = '<div class="content has-sidebar"><article><h1 class="entry-header">Title</h1><p>Body</p></article></div><div class="sidebar-left">menu</div>'
    assert visible_lines(page) == [("Title", MAIN), ("Body", MAIN), ("menu", DROP)]


def test_op8_reader_inflates_a_chunk_at_a_time():
    import io

    from gridflux.llm import warc

    recs = [warc.record([("WARC-Type", "response")], bytes([65 + k % 26]) * 20_000) for k in range(300)]
    packer = zlib.compressobj(6, wbits=31)
    data = b"".join(packer.compress(r) for r in recs) + packer.flush()
    for chunk in (64, 4096):
        assert list(warc.records_of(io.BytesIO(data), chunk)) == recs
    assert list(warc.records_of(io.BytesIO(data + data), 1 << 16)) == recs + recs


def test_three_hundred_languages_can_be_sampled(spark):
    from gridflux.llm.common import bounded_sample

    df = spark.createDataFrame([(i, f"l{i % 300}") for i in range(3000)], "doc_id bigint, lang string")
    got = bounded_sample(df, "lang", "doc_id", 1000, 3000).collect()
    assert len({r.lang for r in got}) == 300


def test_op3_finds_insults_by_pairs_and_alone():
    import numpy as np

    from gridflux.llm.toxicity import FactorizationMachine

    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(3000):  # only the pair 0 and 1 is toxic
        a, b = rng.random(2) < 0.5
        rows.append(np.array(sorted(([0] if a else []) + ([1] if b else []) + [2 + int(rng.integers(20))])))
        y.append(float(a and b))
    m = FactorizationMachine(22).fit(rows, np.array(y), np.ones(len(y)))
    assert m.one(np.array([0, 1, 5])) > 0.9 and m.one(np.array([0, 5])) < 0.3 and m.one(np.array([1, 5])) < 0.3


def test_op4_partners_beyond_a_block_of_copies(spark):
    """Within a block of copies a page found no partner, and kept what it shares with pages further off."""
    from gridflux.llm import html

    story = lambda k: f"<p>{' '.join(f'story{k}word{i}' for i in range(40))}</p>"
    page = lambda k, text: (k, f"http://a.org/{k:03}", f"<article>{text}<p>number {k}</p><p>Subscribe to read on</p></article>")
    pages = [page(k, story(0 if k < 70 else k)) for k in range(72)] + [(99, "http://b.org/1", f"<main>{story(1)}</main>")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    found = [{r.page_id: (r.text, r.n_shared) for r in html.extract(df, block=b).collect()} for b in (4, 10**6)]
    assert found[0] == found[1]
    assert all(n == (1 if k < 72 else 0) and "Subscribe" not in t for k, (t, n) in found[0].items())
