r"""Main text of web pages: mark-up where it says what is what, what a host repeats where it does not.

A page is cut into blocks at block-level tags; scripts, styles, comments and other unseen elements go, character references are decoded, white space
inside a block becomes one space. Blocks inside ``article`` or ``main`` (or an element marked as such), but not inside an element that is
a menu, header, footer, side bar, notice, advert, form or a reader's comment by its tag, class, id or role, are the page's main text.

A page without such an element is judged by its host. The words of all blocks outside main texts form one stream for each page. ``MIN_RUN`` words in a
row that stand on ``MIN_PAGES`` pages of the host or more are boilerplate; a suffix array of the pages' streams tells the runs apart
(``suffix_ranks``). A block of such a page stays unless mark-up speaks against it or boilerplate covers ``COVERED`` of its words; a page
whose blocks would all go for being repeated is a copy of other pages and keeps them.

Main texts are judged by their host as well, but mark-up speaks for them: runs count that stand on more than half of the host's main texts (and on ``MIN_PAGES``), as a
template's lines do; licences, quotations and articles that a few pages repeat stay. A main text whose blocks would all go keeps them. Both kinds of pages have streams of their own.

Runs are counted by Spark over the whole host, whatever its size: tasks count the pages of each run in the suffix array of their chunk, a run's name (64 bits
of its hash with the host's) joins it with those of other chunks, sums over chunks tell which are repeated, and these go back to the chunks that hold them. A run on all pages of a host
is one row for each chunk, and no task holds more than a chunk of ``SLICE_BYTES``. Runs of main texts are first told by their seeds, the least hash of ``SEED`` words inside
a run (a third as many, and no run is on more pages than its seed); only runs whose seed is widespread, by a bitmap of fixed size, are counted themselves.

Rows: a null html is empty and gives an empty text; a null url has the empty host; rows with equal page_ids are judged each; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import coded, hashes, mixed, slices, stored, window_hashes, words_of
from tidemark.llm.decontamination import bitmap
from tidemark.llm.url_filter import host_of
from tidemark.operators.joins import shuffled
from tidemark.session import spent_shuffles

MIN_RUN = 8
MIN_PAGES = 3
COVERED = 0.8
SEED = 4
SEED_BITS, HOST_BITS = 1 << 24, 1 << 16
SALTS = 16

UNSEEN = "script|style|noscript|template|title|svg|math|canvas|iframe|object|video|audio|textarea|select|head\\b(?=[^>]*/>)"
TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<({UNSEEN})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACED = {"br", "td", "th", "img", "input", "wbr", "option"}
MAIN = {"article", "main"}
CUE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "search", "fieldset"}
NEVER_HOLDS_MAIN = {"nav", "header", "footer", "menu", "button", "search"}
CONTAINERS = {"div", "section", "ul", "ol", "p", "table", "span", "li", "header", "details", "article", "figure", "dl", "td", "tr"}
NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CUE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay"
    r"|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|side-bar|widget|footer|masthead|site-header|page-header|topbar"
    r"|comments?|commentlist|respond|disqus|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|search|skip-link"
    r"|complementary|contentinfo|toc|tags|byline-ads)(?:$|[\s_-])",
    re.I,
)
MAIN_NAME = re.compile(r"(?:^|\s)(?:main|articleBody)(?:$|\s)")

PARSED = "chunk long, page_id long, url string, host string, main string, blocks array<string>, cued array<boolean>"


def blocks_of(page: str) -> tuple[list[str], list[str], list[bool]]:
    """Main blocks, other blocks, and which of these mark-up calls boilerplate."""
    main: list[str] = []
    other: list[str] = []
    cued: list[bool] = []
    parts: list[str] = []
    inside = 0  # main elements that are open
    marked = 0  # of these, elements marked as main that are no article or main
    marked_tag = ""
    cue_tag = ""  # the boilerplate element that is open, and how often its tag is open
    cue_depth = 0

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                if cue_depth:
                    other.append(text)
                    cued.append(True)
                elif inside or marked:
                    main.append(text)
                else:
                    other.append(text)
                    cued.append(False)

    place = 0
    for found in TOKEN.finditer(page):
        if found.start() > place:
            parts.append(page[place : found.start()])
        place = found.end()
        tag = found[3]
        if tag is None:
            continue
        tag = tag.lower()
        if found[2]:
            if tag in BLOCK:
                close()
            if cue_depth:
                if tag == cue_tag:
                    cue_depth -= 1
                elif tag in ("body", "html") or (tag in MAIN and inside):
                    cue_depth = 0
            if tag in MAIN and inside and not cue_depth:
                inside -= 1
            if marked and tag == marked_tag:
                marked -= 1
            continue
        if tag in BLOCK:
            close()
        elif tag in SPACED:
            parts.append(" ")
        attributes = found[4]
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        if cue_depth:
            if tag in MAIN and not inside and cue_tag in NEVER_HOLDS_MAIN and not CUE.search(_names(attributes)):
                cue_depth = 0  # a boilerplate element that was never closed
            elif tag == cue_tag:
                cue_depth += 1
                continue
            else:
                continue
        names = _names(attributes) if "=" in attributes else ""
        if tag in CUE_TAGS or (tag == "header" and not inside) or (names and (tag in CONTAINERS or tag in BLOCK) and tag not in ("body", "html", "main") and CUE.search(names)):
            close()
            cue_tag, cue_depth = tag, 1
        elif tag in MAIN:
            inside += 1
        elif marked and tag == marked_tag:
            marked += 1
        elif not marked and names and MAIN_NAME.search(names):
            marked_tag, marked = tag, 1
    parts.append(page[place:])
    close()
    return main, other, cued


def _names(attributes: str) -> str:
    return " ".join(a or b or c for a, b, c in NAMES.findall(attributes))


def parse_pages(pages: DataFrame) -> DataFrame:
    """Blocks of every page, stored."""

    def parse(batches):
        base = TaskContext.get().partitionId() << 33
        for number, batch in enumerate(slices(batches, "html")):
            rows = [blocks_of(x or "") for x in batch.column("html").to_pylist()]
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, base + number)),
                    batch.column("page_id").cast(pa.int64()),
                    batch.column("url"),
                    batch.column("host"),
                    pa.array(["\n".join(m) if m else None for m, _, _ in rows], pa.string()),
                    pa.array([o for _, o, _ in rows], pa.list_(pa.string())),
                    pa.array([c for _, _, c in rows], pa.list_(pa.bool_())),
                ],
                names=["chunk", "page_id", "url", "host", "main", "blocks", "cued"],
            )

    wanted = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    return stored(wanted.mapInArrow(parse, PARSED), "pages-parsed", "zstd")


def suffix_ranks(codes: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each suffix by its first ``depth`` words: prefix doubling, equal ranks for equal beginnings."""
    ranks = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth:
        second = np.full(len(ranks), -1, np.int64)
        shift = min(step, depth - step)
        second[:-shift] = ranks[shift:] if shift < len(ranks) else second[:-shift]
        ranks = np.unique(ranks * (len(ranks) + 1) + second + 1, return_inverse=True)[1].astype(np.int64)
        step += shift
    return ranks


def covered_words(codes: np.ndarray, page: np.ndarray, min_run: int, min_pages: int) -> np.ndarray:
    """Which words lie in a run of ``min_run`` words that stands on ``min_pages`` pages or more.

    ``codes`` are the words of all pages, one page after the other, each page closed by a code of its own; ``page`` numbers their pages.
    """
    ranks = suffix_ranks(codes, min_run)
    order = np.lexsort((page, ranks))
    r, p = ranks[order], page[order]
    new_page = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])])
    pages = np.bincount(r, weights=new_page)
    starts = pages[ranks] >= min_pages
    steps = np.zeros(len(codes) + min_run + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + min_run, -1)
    return np.cumsum(steps)[: len(codes)] > 0


def page_runs(hosts: pa.Array, blocks: pa.Array, min_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of ``min_run`` words of each page, told apart by a suffix array of the pages' words.

    The class of each run (equal words on pages of one host), the name of each class, where each page's runs begin, and where its words begin.
    A name is a hash of host and words, by which the chunks of a host find each other's classes.
    """
    words, bounds = words_of(pc.binary_join(blocks, "\n"))
    distinct, codes = coded(words)
    values = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    runs, at = window_hashes(values, bounds, min_run)
    names, which = coded(hosts)
    of_host = np.repeat(which, np.diff(at))
    # A run lies inside its page, so the suffix that begins there has the run's words for its first.
    first = np.repeat(bounds[:-1] - at[:-1], np.diff(at)) + np.arange(len(runs))
    ranks = suffix_ranks(codes, min_run)[first]
    _, sample, classes = np.unique(ranks * len(names) + of_host, return_index=True, return_inverse=True)
    return classes, mixed(runs[sample] ^ hashes(names, seed=1)[of_host[sample]]), at, bounds


def run_counts(parsed: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """On how many of a chunk's pages each run stands: chunk, run, n (a chunk may give several rows for a run)."""

    def count(batches):
        for batch in batches:
            batch = batch.append_column("size", pc.binary_join(batch.column("blocks"), "\n"))
            for part in slices([batch], "size"):
                chunks = part.column("chunk").to_numpy()
                for chunk in np.unique(chunks):
                    rows = part.take(pa.array(np.flatnonzero(chunks == chunk)))
                    classes, found, at, _ = page_runs(rows.column("host"), rows.column("blocks"), min_run)
                    page = np.repeat(np.arange(rows.num_rows), np.diff(at))
                    order = np.lexsort((page, classes))
                    run, page = classes[order], page[order]
                    new_page = np.concatenate([[True], (run[1:] != run[:-1]) | (page[1:] != page[:-1])])[: len(run)]
                    n = np.bincount(run[new_page], minlength=len(found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), chunk), pa.int64()), pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["chunk", "run", "n"]
                    )

    return parsed.select("chunk", "host", "blocks").mapInArrow(count, "chunk long, run long, n long")


def repeated_blocks(hosts: pa.Array, blocks: pa.Array, repeated: np.ndarray, min_run: int = MIN_RUN, covered: float = COVERED) -> list[list[bool]]:
    """For each page's blocks: is the block boilerplate by the repeated runs?"""
    classes, names, at, bounds = page_runs(hosts, blocks, min_run)
    first = np.repeat(bounds[:-1] - at[:-1], np.diff(at)) + np.arange(len(classes))
    starts = first[np.isin(names, repeated)[classes]]
    steps = np.zeros(bounds[-1] + min_run + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + min_run, -1)
    sums = np.concatenate([[0], np.cumsum(np.cumsum(steps)[: bounds[-1]] > 0)])
    out, place = [], 0
    for page in blocks.to_pylist():
        flags = []
        for block in page:
            size = block.count(" ") + 1
            flags.append(bool(sums[place + size] - sums[place] >= covered * size))
            place += size
        out.append(flags)
    return out


def kept_blocks(blocks: list[str], cued: list[bool], repeated: list[bool]) -> str:
    """The text of a page without main elements."""
    free = [b for b, c in zip(blocks, cued, strict=True) if not c]
    kept = [b for b, c, r in zip(blocks, cued, repeated, strict=True) if not c and not r]
    return "\n".join(kept or free)


def seeds_of(texts: pa.Array, min_run: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray]:
    """For each run of each text the least hash of ``SEED`` words inside it, so equal runs have equal seeds, and where each text's runs begin."""
    words, bounds = words_of(texts)
    distinct, codes = coded(words)
    short, at = window_hashes(hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64), bounds, SEED)
    lengths = np.maximum(np.diff(bounds) - min_run + 1, 0)
    out = np.concatenate([[0], np.cumsum(lengths)])
    first = np.repeat(at[:-1] - out[:-1], lengths) + np.arange(out[-1])
    return np.minimum.reduce([short[first + k] for k in range(min_run - SEED + 1)]), out


def on_pages(keys: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key is first met, and on how many pages it stands."""
    order = np.lexsort((page, keys))
    key, page = keys[order], page[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    new_page = new_key | np.concatenate([[True], page[1:] != page[:-1]])[: len(key)]
    return order[new_key], np.bincount(np.cumsum(new_key)[new_page] - 1, minlength=int(new_key.sum()))


def main_counts(marked: DataFrame, seed_bits: np.ndarray | None = None) -> DataFrame:
    """On how many main texts of a slice each seed stands, or each run whose seed is among ``seed_bits``: home, run, n."""
    held = None if seed_bits is None else marked.sparkSession.sparkContext.broadcast(seed_bits)

    def count(batches):
        for part in slices(batches, "main"):
            homes = part.column("home").to_numpy().view(np.uint64)
            seeds, at = seeds_of(part.column("main"))
            page = np.repeat(np.arange(part.num_rows), np.diff(at))
            # Half of a hash takes half the room; seeds that share it only let further runs be counted.
            keys = mixed(seeds ^ homes[page]) >> np.uint64(32)
            if held is not None:
                low = keys & np.uint64(len(held.value) * 64 - 1)
                hit = (held.value[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) > 0
                rows = np.unique(page[hit])
                some = part.take(pa.array(rows))
                classes, names, _, _ = page_runs(some.column("host"), pc.split_pattern(some.column("main"), "\n"), MIN_RUN)
                keys, page = names[classes[hit[np.isin(page, rows)]]], page[hit]
            first, n = on_pages(keys, page)
            order = np.argsort(homes[page[first]], kind="stable")  # equal values side by side are shuffled in less room
            first, n = first[order], n[order]
            columns = homes[page[first]].view(np.int64), keys[first].view(np.int64), n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["home", "run", "n"])

    return marked.mapInArrow(count, "home long, run long, n long")


def widespread(counted: DataFrame, marked: DataFrame) -> DataFrame:
    """home and run of those on more than half of a host's main texts, and on ``MIN_PAGES`` of them."""
    pages = counted.groupBy("home", "run").agg(F.sum("n").alias("pages")).filter(F.col("pages") >= MIN_PAGES)
    of = marked.groupBy("home").agg(F.count(F.lit(1)).alias("of")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pages.withColumn("salt", F.pmod("run", F.lit(SALTS)).cast("int"))
    return salted.join(shuffled(of), ["home", "salt"]).filter(F.col("pages") * 2 > F.col("of")).select("home", "run")


def judged_main(marked: DataFrame) -> DataFrame:
    """page_id, url, main of the pages with a main text, without the lines that their host's main texts share."""
    with spent_shuffles(marked.sparkSession):
        seed_bits = bitmap(widespread(main_counts(marked), marked).select(F.col("run").alias("seed")), SEED_BITS)
        runs = stored(widespread(main_counts(marked, seed_bits), marked), "main-widespread")
        homes = bitmap(runs.select(F.col("home").alias("seed")), HOST_BITS)
    # Hosts without such runs, but for a few that share a bit with another, are told without a join, and their texts stay where they are.
    word = F.element_at(F.lit(homes.view(np.int64).tolist()).cast("array<bigint>"), F.expr(f"cast(shiftright(home & {HOST_BITS - 1}L, 6) as int) + 1"))
    marked = marked.withColumn("met", F.call_function("shiftrightunsigned", word, F.expr("cast(home & 63 as int)")).bitwiseAND(F.lit(1)) == 1)
    met = marked.filter("met")

    def judge(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        host, text = (pa.concat_arrays(left.column(c).chunks) if left.num_rows else pa.array([], pa.string()) for c in ("host", "main"))
        blocks = pc.split_pattern(text, "\n")
        flags = repeated_blocks(host, blocks, right.column("run").to_numpy().view(np.uint64))
        texts = [kept_blocks(b, [False] * len(b), f) for b, f in zip(blocks.to_pylist(), flags, strict=True)]
        return pa.table({"page_id": left.column("page_id"), "url": left.column("url"), "main": pa.array(texts, pa.string())})

    found = met.select("chunk", "home").distinct().join(shuffled(runs), "home").select("chunk", "home", "run").toDF("chunk", "home", "run")
    key = ["chunk", "home"]
    judged = met.select("chunk", "home", "page_id", "url", "host", "main").groupBy(*key).cogroup(found.groupBy(*key)).applyInArrow(judge, "page_id long, url string, main string")
    return marked.filter("not met").select("page_id", "url", "main").unionByName(judged)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    parsed = parse_pages(pages)
    counted = stored(run_counts(parsed), "main-runs")
    unmarked = parsed.filter("main is null").select("chunk", "page_id", "url", "host", "blocks", "cued")
    repeated = counted.groupBy("run").agg(F.sum("n").alias("pages")).filter(F.col("pages") >= MIN_PAGES).select("run")
    wanted = counted.join(unmarked.select("chunk").distinct(), "chunk", "left_semi").select("chunk", "run").distinct()

    def judge(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        host, blocks = (pa.concat_arrays(left.column(c).chunks) if left.num_rows else pa.array([], left.schema.field(c).type) for c in ("host", "blocks"))
        flags = repeated_blocks(host, blocks, right.column("run").to_numpy().view(np.uint64))
        texts = [kept_blocks(b, c, f) for b, c, f in zip(blocks.to_pylist(), left.column("cued").to_pylist(), flags, strict=True)]
        return pa.table({"page_id": left.column("page_id"), "url": left.column("url"), "main": pa.array(texts, pa.string())})

    found = wanted.join(repeated, "run").select("chunk", "run")
    judged = unmarked.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(judge, "page_id long, url string, main string")
    marked = parsed.filter("main is not null").select("chunk", "page_id", "url", "host", F.xxhash64("host").alias("home"), "main")
    out = judged_main(marked).unionByName(judged)
    text = F.coalesce(F.col("main"), F.lit(""))
    return out.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
