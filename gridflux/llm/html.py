"""Main text of web pages by differencing against the page of the nearest URL.

A page becomes visible lines, one per block. Markup is a further filter: of a page with <article> or <main> only the lines
inside them, of any other page only the lines outside menus, headers, footers, sidebars, notices, adverts, forms and comments
are its body. Every page is paired by URL path within its host: in the order of (host, path, page_id) a page's partner is the
neighbour with the longer common path; the lines of the two are aligned by longest common subsequence, and shared lines are
deleted from the body. Pages of a host with equal bodies stand as one, under the least URL, so no page meets its own copy. A
neighbour that shares over `copy_share` of the characters of the smaller body may be an edited copy and is passed over for the
next nearest page of the block. If all are, a page with an article keeps its body, for its article lines show the copy; of any
other page the template is what it shares with the nearest page.

The order comes from a range-partitioned sort of line hashes, not of pages; ranks are cut into blocks of `block` rows that
overlap by one, so a host of any size spreads over many tasks and the pairing does not depend on partitions.

Edge cases: null and empty html give an empty text; broken and unclosed markup is read to its end; a null or odd url has an
empty host and path; rows that share page_id and html share their result; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflux.llm.common import only, sized, stored, table, with_computed

OPEN, MAIN, DROP = 0, 1, 2
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|select|button|title)\b(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?][^<>]*>"
    r"|<(?P<raw2>script|style|noscript|template|svg|iframe|object|textarea|select|button|title)\b[^<>]*>.*?(?:</(?P=raw2)\s*>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<attrs2>[^<>]*)>",  # a quote is not closed: the tag ends at the next >
    re.S | re.I,
)
_MARKS = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LETTERS = re.compile(r"[a-z]+")
# fixed values: element names and the words in class, id and role that mark what is not the article
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HELD = frozenset("article aside details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
NOT_TEXT = frozenset("aside dialog footer form head header menu nav".split())
MARKS = frozenset("ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promos promotion related respond search share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget widgets".split())
# fixed values: words that beside a mark leave it a mark, as in sidebar-left; beside another word (has-sidebar, entry-header) it is none
BESIDE = frozenset("area bar block body bottom box center col column container content footer global group header holder image inner item items left link links list main middle mobile page primary right row secondary section site slot small span text title top unit wrap wrapper zone".split())
REPLIES = frozenset("comment comments disqus respond".split())


def marks(attrs: str) -> set[str]:
    """The marks among the names in class, id and role: a name counts if it consists of marks and words that may stand beside them."""
    out: set[str] = set()
    for a in _MARKS.finditer(attrs):
        for name in (a[1] or a[2] or a[3] or "").lower().split():
            parts = set(_LETTERS.findall(name))
            if parts <= MARKS | BESIDE:
                out |= parts & MARKS
    return out


def visible_lines(page: str | None) -> list[tuple[str, int]]:
    """(line, OPEN | MAIN | DROP) in page order."""
    lines: list[tuple[str, int]] = []
    held: list[tuple[str, int]] = []  # open containers and the state inside them
    state, buffer, at, page = OPEN, [], 0, page or ""

    def flush() -> None:
        if buffer:
            if text := " ".join(entities.unescape("".join(buffer)).split()):
                lines.append((text, state))
            buffer.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        tag, attrs = (m["tag"] or m["tag2"] or "").lower(), m["attrs"] or m["attrs2"] or ""
        if not tag:
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if held and held[-1][0] == "p":  # a paragraph ends where a block begins
                held.pop()
                state = held[-1][1] if held else OPEN
        if m["close"] or m["close2"]:
            for k in range(len(held) - 1, -1, -1):
                if held[k][0] == tag:
                    flush()
                    del held[k:]
                    state = held[-1][1] if held else OPEN
                    break
            continue
        words = marks(attrs) if "=" in attrs else set()
        marked, inside = bool(words), state
        if tag in ("article", "main") and not marked and not any(s == DROP + 1 for _, s in held):
            inside = MAIN
        elif words & REPLIES:
            inside = DROP + 1  # replies: an article element in them is a reply too
        elif state <= MAIN and (marked or tag in NOT_TEXT and not (tag == "header" and state == MAIN)):
            inside = DROP
        if tag in HELD or inside != state and tag not in ("html", "body") and not attrs.endswith("/"):
            if tag not in HELD:
                flush()
            held.append((tag, inside))
            state = inside
    if at < len(page):
        buffer.append(page[at:])
    flush()
    return [(t, min(s, DROP)) for t, s in lines]


def body_kind(lines: list[tuple[str, int]]) -> int:
    """The state of the lines that are the page's body."""
    return MAIN if any(s == MAIN for _, s in lines) else OPEN


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = list(range(lo)) + list(range(len(a) - hi, len(a)))
    a2, b2 = a[lo : len(a) - hi], b[lo : len(b) - hi]
    both = set(a2) & set(b2)
    at = [i for i, x in enumerate(a2) if x in both]
    return sorted(out + [lo + at[i] for i in _align([a2[i] for i in at], [x for x in b2 if x in both])])


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a with every prefix of b, by bit vectors."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _align(a: list[int], b: list[int]) -> list[int]:
    """By halves of a: the split of b that the two halves' lengths allow is found in linear memory."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    mid = len(a) // 2
    cut = int((_lengths(a[:mid], b) + _lengths(a[mid:][::-1], b[::-1])[::-1]).argmax())
    return _align(a[:mid], b[:cut]) + [mid + i for i in _align(a[mid:], b[cut:])]


def ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with `rank`, their place from 0 in the order of keys: a range-partitioned sort and per-partition offsets."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = stored(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("__part"), place.alias("__place")), "ranked")
    counts, before, offsets = parts.groupBy("__part").count().orderBy("__part").collect(), 0, []
    for r in counts:  # one number per partition
        offsets.append((r["__part"], before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(offsets, "__part int, __before bigint")
    return parts.join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")


def shared_lines(pages: DataFrame, block: int = 64, copy_share: float = 0.6) -> DataFrame:
    """(page_id, row, shared): positions in the body of the lines that pages share with their partner."""
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), "[?#].*$", "")
    host, path = F.lower(F.regexp_extract(bare, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/]*)", 1)), F.regexp_extract(bare, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(/.*)$", 1)

    def compute():
        import pyarrow as pa
        import xxhash

        def step(column):
            seen = [visible_lines(t.as_py()) for t in column]
            hashes = [[xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in ls] for ls in seen]
            sizes = [[len(t) if s == kind else 0 for t, s in ls] for ls, kind in ((ls, body_kind(ls)) for ls in seen)]
            kinds = [body_kind(ls) for ls in seen]
            bodies = [xxhash.xxh64_intdigest(repr([t for t, s in ls if s == kind])) - (1 << 63) for ls, kind in zip(seen, kinds)]
            return [pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(bodies, pa.int64()), pa.array([k == MAIN for k in kinds], pa.bool_())]

        return step

    rows = with_computed(pages.select("page_id", "row", host.alias("host"), path.alias("path"), "html"), "html", compute, "lines array<bigint>, sizes array<int>, body bigint, main boolean").drop("html")
    rows = stored(rows, "lines")
    least = F.min(F.struct("path", "page_id", "row", "lines", "sizes", "main")).alias("least")
    heads = rows.groupBy("host", "body").agg(least).select("host", "body", "least.*")
    rank = ranked(heads, "host", "path", "page_id", "row")
    ends = stored(rank.groupBy("host").agg(F.min("rank").alias("since"), F.max("rank").alias("until")), "hosts")
    rank = rank.join(sized(ends, 1_000_000), "host")
    own = F.floor(F.col("rank") / block)
    spread = F.array_compact(F.array(own, F.when((F.col("rank") % block == 0) & (own > 0), own - 1), F.when(F.col("rank") % block == block - 1, own + 1)))

    def pair(key, pdf):
        import pandas as pd

        pdf, out = pdf.sort_values("rank").reset_index(drop=True), []
        for i, r in enumerate(pdf.itertuples()):
            if not np.any(r.sizes) or r.rank // block != key[0]:
                continue
            fallback, rest = None, False
            for j in outward(pdf, i):
                if rest := j is None:
                    break
                same, copy = in_common(r, pdf.iloc[j], copy_share)
                if not copy:
                    fallback = same
                    break
                if fallback is None and not r.main:
                    fallback = same
            if fallback or rest:
                out.append((r.host, r.body, fallback or [], rest))
        return pd.DataFrame(out, columns=["host", "body", "shared", "rest"])

    shared = stored(rank.withColumn("block", F.explode(spread)).groupBy("block").applyInPandas(pair, "host string, body bigint, shared array<int>, rest boolean"), "shared")
    rest = shared.where("rest").select("host", "body", F.col("shared").alias("fallback"))
    shared = shared.where("not rest").select("host", "body", "shared")
    for found in wider(rank.withColumn("block", own), rest, block, copy_share):
        shared = shared.union(found)
    return rows.select("page_id", "row", "host", "body").join(shared, ["host", "body"]).select("page_id", "row", "shared").dropDuplicates(["page_id", "row"])


def in_common(r, other, copy_share: float) -> tuple[list[int], bool]:
    """Positions in r's body of the lines that both pages hold, and whether these are so many that one is a copy of the other."""
    places = np.cumsum(np.array(r.sizes) > 0) - 1
    same = [k for k in common_lines(list(r.lines), list(other.lines)) if r.sizes[k]]
    weight = sum(int(r.sizes[k]) for k in same)
    return [int(places[k]) for k in same], weight > copy_share * max(1, min(int(np.sum(r.sizes)), int(np.sum(other.sizes))))


def wider(rank: DataFrame, rest: DataFrame, block: int, copy_share: float):
    """(host, body, shared) of the pages whose search leaves their block, as it settles.

    Such a page meets further blocks of its host, twice as far in each round, until it has a partner that no page beyond
    can be nearer than, or its host ends. Away from a page common prefixes only get shorter, so those met so far bound
    the others. A group is two blocks, however long a run of copies is.
    """
    none = "cast(null as struct<prefix: int, back: bigint, low: int, shared: array<int>>)"
    left = stored(rank.join(rest, ["host", "body"]).withColumn("best", F.expr(none)), "rest")
    near, far = 0, 2
    kind = "rank bigint, best struct<prefix: int, back: bigint, low: int, shared: array<int>>, front struct<prefix: int, back: bigint>, low int"

    def meet(key, pdf):
        import pandas as pd

        pages, out = pdf[pdf["probe"] == 0].sort_values("rank"), []
        for r in pdf[pdf["probe"] == 1].itertuples():
            there = pages[pages["host"] == r.host]
            for low, side in ((1, there[there["rank"] < r.rank][::-1]), (0, there[there["rank"] > r.rank])):
                if not len(side):
                    continue
                best, last = None, side.iloc[-1]
                for other in side.itertuples():
                    same, copy = in_common(r, other, copy_share)
                    if not copy:
                        best = {"prefix": _prefix(r.path, other.path), "back": -abs(r.rank - other.rank), "low": low, "shared": same}
                        break
                out.append((r.rank, best, {"prefix": _prefix(r.path, last["path"]), "back": -abs(r.rank - int(last["rank"])) - 1}, low))
        return pd.DataFrame(out, columns=["rank", "best", "front", "low"])

    while not left.isEmpty():
        first, last = F.floor(F.col("since") / block), F.floor(F.col("until") / block)
        at = [F.sequence(F.greatest(first, F.col("block") - (far - 1)), F.col("block") - near), F.sequence(F.col("block") + near, F.least(last, F.col("block") + far - 1))]
        at = F.array_union(F.when(F.col("block") - near >= first, at[0]).otherwise(F.array().cast("array<bigint>")), F.when(F.col("block") + near <= last, at[1]).otherwise(F.array().cast("array<bigint>")))
        fields = ["host", "path", "rank", "lines", "sizes"]
        probes = left.select(*fields, F.col("block").alias("home"), F.explode(at).alias("met"))
        pages = rank.select(*fields, F.col("block").alias("met")).join(probes.select("home", "met").distinct(), "met")
        both = probes.withColumn("probe", F.lit(1)).select(*fields, "home", "met", "probe").union(pages.withColumn("probe", F.lit(0)).select(*fields, "home", "met", "probe"))
        seen = stored(both.groupBy("home", "met").applyInPandas(meet, kind), "met")
        sides = seen.groupBy("rank").agg(F.max("best").alias("now"), F.min(F.when(F.col("low") == 1, F.col("front"))).alias("lo"), F.min(F.when(F.col("low") == 0, F.col("front"))).alias("hi"))
        after = left.join(sides, "rank", "left").withColumn("best", F.greatest("best", "now")).drop("now")
        key = F.struct(F.col("best.prefix").alias("prefix"), F.col("best.back").alias("back"))
        closed = lambda end, front: end | (F.col("best").isNotNull() & F.coalesce(F.col(front) < key, F.lit(False)))
        over = closed(F.col("block") - (far - 1) <= first, "lo") & closed(F.col("block") + (far - 1) >= last, "hi")
        after = stored(after.withColumn("over", over), "rest")
        yield after.where("over").select("host", "body", F.coalesce("best.shared", "fallback").alias("shared"))
        left = after.where("not over").drop("lo", "hi", "over")
        near, far = far, 2 * far


def outward(pdf, i: int):
    """Row numbers of the other pages of row i's host, nearest URL first; None where a page outside pdf may be the next one."""
    hosts, paths, ranks, lo, hi = pdf["host"], pdf["path"], pdf["rank"], i - 1, i + 1
    since, until = pdf["since"][i], pdf["until"][i]
    while True:
        ends = [j for j in (lo, hi) if 0 <= j < len(pdf) and hosts[j] == hosts[i]]
        beyond = [j for j, more in ((lo + 1, lo < 0 and ranks[0] > since), (hi - 1, hi >= len(pdf) and ranks[len(pdf) - 1] < until)) if more]
        near = lambda j: (_prefix(paths[i], paths[j]), -abs(i - j))
        j = max(ends, key=near) if ends else None
        if any(j is None or (_prefix(paths[i], paths[k]), -abs(i - k) - 1) >= near(j) for k in beyond):
            yield None
            return
        if j is None:
            return
        yield j
        lo, hi = (j - 1, hi) if j < i else (lo, j + 1)


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def extract(pages: DataFrame, block: int = 64, copy_share: float = 0.6) -> DataFrame:
    """page_id, url, text, n_chars, and n_shared, the lines that differencing deleted."""
    import json

    rows = pages.select(F.col("page_id").cast("bigint"), "url", "html").withColumn("row", F.xxhash64("page_id", "url", "html"))
    shared = shared_lines(rows, block, copy_share)
    key = F.struct(F.coalesce("page_id", F.lit(-1)).alias("p"), F.col("row").alias("r"))
    both = rows.withColumn("k", key).join(shared.select(key.alias("k"), "shared"), "k", "left")
    both = both.select("page_id", "url", F.to_json(F.struct(F.coalesce("shared", F.array().cast("array<int>")).alias("s"))).alias("s"), "html").withColumn("both", F.concat("s", F.lit("\n"), F.coalesce("html", F.lit(""))))

    def compute():
        import pyarrow as pa

        def step(column):
            texts, gone = [], []
            for c in column:
                said, _, page = c.as_py().partition("\n")
                lines, lost = visible_lines(page), set(json.loads(said)["s"])
                kind = body_kind(lines)
                texts.append(" ".join(t for i, t in enumerate(t for t, s in lines if s == kind) if i not in lost))
                gone.append(len(lost))
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64())]

        return step

    return with_computed(both.select("page_id", "url", "both"), "both", compute, "text string, n_chars bigint, n_shared bigint").drop("both")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(only(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
