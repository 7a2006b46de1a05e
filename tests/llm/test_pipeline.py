"""Each stage on awkward rows, on none, and with extra columns."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from gridflux.llm.common import stored

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def through(spark, docs, sf_dir):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, sf_dir), name)
        out[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    return out


def test_empty(spark):
    assert all(d.count() == 0 for d in through(spark, spark.createDataFrame([], SCHEMA), SMALL).values())


def test_small_tables_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = through(spark, docs, SMALL)
    n = {k: v.count() for k, v in out.items()}
    assert n["language_id"] >= 0.8 * docs.count()
    assert n["near_dedup" if "near_dedup" in n else "simhash_dedup"] > 0
    packed = out["packing"]
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in out["decontaminate"].select("doc_id").collect()}


@pytest.mark.parametrize("names", [["a.b"], ["lang_pred", "score", "n_lines", "lost", "fp", "component_id"], ["__found", "__more", "__keep", "__id", "__row", "__lost"]])
def test_extra_columns_survive(spark, names):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({c: F.lit(3) for c in names})
    plain = through(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    wide = through(spark, docs, SMALL)
    for name, _ in corpus_pipeline.STAGES:
        assert wide[name].count() == plain[name].count()
    last = wide["decontaminate"]
    assert last.where(" and ".join(f"`{c}` = 3" for c in names)).count() == last.count()


def test_texts_that_share_a_doc_id_are_both_kept(spark):
    docs = [(5, " ".join(f"alpha{i}" for i in range(40))), (5, " ".join(f"beta{i}" for i in range(40))), (6, " ".join(f"alpha{i}" for i in range(40))), (7, None), (8, ""), (None, "no id at all")]
    wide = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in docs * 2], SCHEMA)
    kept = [(r.doc_id, (r.text or "")[:4]) for r in corpus_pipeline.near_duplicates(spark, wide, SMALL).collect()]
    assert sorted(kept, key=str) == sorted([(5, "alph"), (5, "beta"), (7, ""), (None, "no i"), (None, "no i")], key=str)


def test_near_duplicates_are_all_pairs_at_four_fifths(spark):
    import random

    from gridflux.llm import neardup

    rng = random.Random(3)
    docs = []
    for base in range(6):
        words = [f"v{rng.randrange(400)}" for _ in range(rng.choice((12, 60, 200)))]
        for copy in range(12):
            w = list(words)
            for _ in range(rng.randrange(1 + len(w) // 30)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    docs += [(len(docs), None), (len(docs) + 1, " "), (len(docs) + 2, "two words"), (len(docs) + 3, "Two  WORDS")]
    sets = {}
    for i, text in docs:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i, _ in docs}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in docs:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for crowd in (3, 64):
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, crowd=crowd).collect()} == root
    wide = df.withColumns({"lang": F.lit("en"), "source": F.lit("web"), "n_chars": F.length("text").cast("bigint")})
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, wide, SMALL).collect()}
    assert kept == set(root.values())


def test_components_write_few_files_for_few_edges(spark, monkeypatch):
    """With 211 partitions that are not coalesced each round wrote a file a partition."""
    from gridflux.llm import simhash

    written, plain = {}, simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name: written.setdefault(name, []).append((out := plain(df, name)).inputFiles()) or out)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chain = [(i, i + 1) for i in range(40) if i % 10 != 9]
        roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert roots == {i: i // 10 * 10 for i in range(40)}
    assert max(len(files) for name in ("large", "small") for files in written[name]) == 1


def test_texts_travel_in_small_batches(spark):
    """A whole partition of 3,000 texts came as one batch."""
    from gridflux.llm.common import with_computed

    def compute():
        import pyarrow as pa

        return lambda texts: [pa.array([len(texts)] * len(texts), pa.int64())]

    df = with_computed(spark.range(3_000).coalesce(1).select(F.col("id").cast("string").alias("text")), "text", compute, "batch bigint")
    assert df.agg(F.max("batch")).first()[0] <= 1_000 and df.count() == 3_000


def test_moved_shingles_cost_no_pass_over_their_list(spark):
    """Each text sorted the whole list of moved shingles, which grows with the corpus: 0.16 s a text for 200,000."""
    import random
    import time

    from gridflux.llm import neardup

    texts = [(k, k, " ".join(f"w{k}x{j}" for j in range(40))) for k in range(500)]
    rows = spark.createDataFrame(texts, "r bigint, doc_id bigint, text string").coalesce(1)
    whole = {r.r: r.hashes for r in neardup.shingled(rows, 5, None).collect()}
    hot = [*random.Random(1).sample(range(1 << 62), 199_999), whole[7][0]]
    began = time.time()
    found = {r.r: r.hashes for r in neardup.shingled(rows, 5, hot).collect()}
    assert time.time() - began < 30
    assert found[8] == whole[8][:8] and found[7] == whole[7][1:9]


def test_shingles_of_a_batch_are_those_of_each_text():
    from gridflux.llm import neardup

    texts = [b"", b" ", b"a", b"A b", b"a\x00 b", b"a b\x00", b"x" * 8, b"x" * 9, b"x" * 64, b"x" * 65, b"\t\n a\x0b\x0cB\rc d e f", b"a b c d e", b"a b c d e f " * 100, "Ünder Ü ü".encode()]
    for width in (1, 2, 5):
        words = [t.lower().split() for t in texts]
        brute = [{tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for w in words]
        ours = [set(s.tolist()) for s in neardup.shingle_sets(texts, width)]
        assert [[len(a & b) for b in ours] for a in ours] == [[len(a & b) for b in brute] for a in brute]
        assert ours == [set(neardup.shingle_sets([t], width)[0].tolist()) for t in texts]


def test_a_text_of_many_lines_is_split_once(spark):
    """Each line that stays had the whole text split anew."""
    import time

    from gridflux.llm import linededup

    own = [f"a line of its own {k}" for k in range(20_000)]
    docs = spark.createDataFrame([(1, "a line of two documents\nshort"), (2, "\n".join(x for y in own for x in (y, "A line of two documents ", "short")))], "doc_id bigint, text string")
    began = time.time()
    found = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert time.time() - began < 60
    assert found[2].text == "\n".join(x for y in own for x in (y, "short")) and (found[2].n_lines, found[2].n_dropped) == (60_000, 20_000)


def test_latin_texts_are_normalised_as_others():
    from gridflux.llm import decontaminate

    for text in [chr(c).join(("a", "B", "", "c")) for c in range(0x250)] + [None, "", " _ "]:
        assert decontaminate.plain(text) == decontaminate._GAP.sub(" ", (text or "").lower()).strip()


def test_windows_by_pairs_match_look_ups_one_by_one():
    import numpy as np

    from gridflux.llm import langid

    net = langid.ByteCNN(["a", "b", "c"])
    x = np.random.default_rng(2).integers(0, 256, (70, langid.WINDOW)).astype(np.uint8)
    z = np.maximum(net._pooled(x)[0], 0)
    assert np.allclose(net.probabilities(x, net.compiled()), langid._softmax(z @ net.p["d"] + net.p["b"]), atol=1e-6)
