"""Main text of web pages by equivalence-class template deduction."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut
from .kernels import hash_words, mix64

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_STOP = re.compile(r"""=\s*(["'])|>""")
RAW_END = {name: re.compile(rf"</{name}(?![a-zA-Z0-9])[^>]*>?", re.IGNORECASE) for name in ("script", "style")}
#: An attribute's name with its value, read as a whole, so that no value is searched for names.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# HTML elements without content, elements inside a line, elements that end an open paragraph, and parts of a page that aren't its article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
FURNITURE = frozenset("head title nav footer aside form button select textarea option iframe object svg canvas noscript template menu dialog script style".split())
FURNITURE_NAMES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer gdpr masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promotion recommended related respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that say where or how furniture stands: a class or id of furniture names and these alone is furniture's, so `cookie-banner` and `site-footer` are, and `social-science` isn't.
MODIFIERS = frozenset("site page main top bottom left right side header box bar area list section block container wrapper wrap panel unit slot button buttons link links item items icon icons inner outer global primary secondary sticky floating inline post article content form text title group row small large mobile desktop js".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Furniture that stands inside a line and doesn't end it.
INLINE_FURNITURE = frozenset("button select textarea iframe object svg canvas noscript template script style".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

# Elements that hold a part of a page rather than a line of it, and headings.
CONTAINERS = frozenset("body div section table tbody tr td center fieldset ul ol dl blockquote details".split())
HEADINGS = frozenset("h1 h2".split())

#: Share of a host's different pages that a template token must be on, tokens of a class, and different pages of a host that can have a template.
SUPPORT, CLASS_SIZE, LEAST_PAGES = 0.9, 3, 3
#: Bytes of templates up to which they are broadcast.
BROADCAST_BYTES = 64_000_000

_MASK = (1 << 64) - 1


@dataclass
class Block:
    """A run of text between block boundaries."""

    path: int  # hash of the path of elements
    text: str
    furniture: bool
    article: int  # 2 in an article element, 1 in the main one, else 0
    heading: bool
    container: int  # the innermost element of the template that holds a part of the page, among Page.containers
    at: int  # among tags and blocks
    named: int = 0  # the outermost element around it that only its names make furniture; below 0 if it is a reader's comment


@dataclass
class Page:
    blocks: list[Block]
    tags: list[tuple[int, int]]  # place, hash of the path of an opened element
    containers: list[tuple[int, int]]  # each one's parent, which comes before it, and token; the first is the page


def _names(value: str, wanted: frozenset[str]) -> bool:
    """Whether one of the class or id names in value is made of wanted words, at least one, and modifiers."""
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub("[0-9]+", "", name)) if w]
        if not wanted.isdisjoint(words) and all(w in wanted or w in MODIFIERS for w in words):
            return True
    return False


def _attributes(name: str, attributes: str, article: int) -> tuple[bool, bool, str]:
    """Whether an element is furniture, whether only its class, id or place says so, and its label: name, class and id without digits.

    An article within an article, or one named after comments, is a reader's comment.
    """
    furniture, named, label = name in FURNITURE or (name == "header" and not article), name == "article" and article == 2, name
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value)) or (key == "role" and value in FURNITURE_ROLES):
            furniture = True
        elif key in ("class", "id"):
            label += f" {key}=" + re.sub("[0-9]+", "", value)
            if name not in ("body", "html", "main"):
                named = named or _names(value, COMMENTS if name == "article" else FURNITURE_NAMES)
    return furniture, named and not furniture, label


def scan_markup(page: str) -> Iterator[tuple[str, str, str]]:
    """(text before, tag name with / if it closes, attributes) in one forward pass; the last has no name.

    Comments, declarations, scripts and styles are left out. A tag ends at the next >
    outside quoted values. If quotes never close, they count for nothing from there on, and a tag
    that never ends is the end of the page, so each character is looked at a bounded
    number of times, whatever the markup.
    """
    at, start, quotes, size = 0, 0, True, len(page)
    while (start := page.find("<", start)) >= 0:
        closing = page.startswith("/", start + 1)
        m = NAME.match(page, start + 1 + closing)
        if m is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                end = size if end < 0 else end + 3
            elif page.startswith(("<!", "<?"), start):
                end = page.find(">", start)
                end = size if end < 0 else end + 1
            else:
                start += 1
                continue
            yield page[at:start], "", ""
            at = start = end
            continue
        stop = m.end()
        while quotes:
            found = TAG_STOP.search(page, stop)
            if found is None:
                quotes = False
            elif found[0] == ">":
                stop = found.start()
                break
            else:
                stop = page.find(found[1], found.end()) + 1
                quotes = stop > 0
        if not quotes:
            stop = page.find(">", m.end())
        end = size if stop < 0 else stop + 1
        name = m[0].lower()
        yield page[at:start], "/" + name if closing else name, page[m.end() : end - 1]
        if name in RAW_END and not closing:
            over = RAW_END[name].search(page, end)
            end = over.end() if over else size
            yield "", "/" + name, ""
        at = start = end
    yield page[at:], "", ""


def read_page(page: str, template: set[int] = frozenset()) -> Page:
    """The blocks and tags of a page in page order, and its parts by the elements in `template` (hashes of paths).

    Elements left open are closed by what encloses them, an open paragraph by the next block.
    """
    out = Page([], [], [(0, 0)])
    stack: list[tuple[str, int, bool, int, bool, int, int]] = []  # name, path, furniture, article, heading, container, named
    outside = ("", 0, False, 0, False, 0, 0)
    opened: Counter[str] = Counter()
    siblings: Counter[tuple[int, str]] = Counter()
    run: list[str] = []
    muted: int | None = None  # the place in the stack of furniture inside a line; its text goes, the line goes on
    elements = 0

    def around() -> tuple[str, int, bool, int, bool, int, int]:
        depth = len(stack) if muted is None else muted
        return stack[depth - 1] if depth else outside

    def flush():
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            _, path, furniture, article, heading, container, named = around()
            out.blocks.append(Block(path, text, furniture, article, heading, container, len(out.tags) + len(out.blocks), named))

    def close(depth: int):
        nonlocal muted
        opened.subtract(entry[0] for entry in stack[depth:])
        del stack[depth:]
        if muted is not None and depth <= muted:
            muted = None

    for before, name, attributes in scan_markup(page):
        if before and muted is None:
            run.append(before)
        if not name:
            continue
        if name[0] == "/":
            name = name[1:]
            if opened[name] > 0:
                depth = next(d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name)
                if name not in INLINE and name not in INLINE_FURNITURE and (muted is None or depth < muted):
                    flush()
                close(depth)
            elif name not in INLINE and name not in INLINE_FURNITURE and muted is None:
                flush()
            continue
        if name in VOID:
            if name in ("br", "hr") and muted is None:
                flush()
            continue
        _, path, furniture, article, heading, container, named = stack[-1] if stack else outside
        hard, soft, label = _attributes(name, attributes, article)
        within = name in INLINE or name in INLINE_FURNITURE
        if not within and muted is None:
            flush()
        if name in ENDS_PARAGRAPH and opened["p"] > 0:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    flush()
                    close(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
            _, path, furniture, article, heading, container, named = stack[-1] if stack else outside
            hard, soft, _ = _attributes(name, attributes, article)
        if label in CONTAINERS and (not stack or stack[-1][0] in CONTAINERS):  # parts of a page without class and id are told apart by their order
            siblings[path, label] += 1
            label += str(siblings[path, label])
        path = ((path ^ zlib.crc32(label.encode("utf-8", "replace"))) * 0x9E3779B97F4A7C15 + 1) & _MASK
        if name in CONTAINERS and tag_token(path) in template:
            out.containers.append((container, tag_token(path)))
            container = len(out.containers) - 1
        if not attributes.rstrip().endswith("/"):
            elements += 1
            if within and (hard or soft) and not furniture and not named and muted is None:
                muted = len(stack)
            named = named or ((-elements if name == "article" else elements) if soft and not furniture else 0)
            stack.append((name, path, furniture or hard, max(article, {"article": 2, "main": 1}.get(name, 0)), heading or name in HEADINGS, container, named))
            opened[name] += 1
        out.tags.append((len(out.tags) + len(out.blocks), path))
    flush()
    _settle(out.blocks)
    return out


def _settle(blocks: list[Block]) -> None:
    """Makes blocks in elements named like furniture furniture, but for an element that holds most of a marked article; comments go if an article is left."""
    sizes: Counter[int] = Counter()
    for b in blocks:
        if b.article == 2 and not b.furniture:
            sizes[b.named] += len(b.text)
    own = sum(n for named, n in sizes.items() if named >= 0)
    for b in blocks:
        if (b.named > 0 and 2 * sizes[b.named] <= own) or (b.named < 0 and own):
            b.furniture = True


def tag_token(path: int) -> int:
    """The token of an opened element: even; that of a text is odd."""
    return ((path ^ (path >> 31)) * 0xBF58476D1CE4E5B9 & _MASK & ~1) - (1 << 63)


def text_tokens(blocks: list[Block]) -> np.ndarray:
    if not blocks:
        return np.empty(0, np.int64)
    hashed = hash_words([b.text.encode("utf-8", "replace") for b in blocks])
    paths = np.array([b.path for b in blocks], np.uint64)
    return (mix64(hashed ^ mix64(paths)) | np.uint64(1)).view(np.int64)


def token_sequence(page: str | None) -> np.ndarray:
    """A page's tokens in page order: a tag by its path (even), a block of text by path and text (odd)."""
    read = read_page(page or "")
    places = [at for at, _ in read.tags] + [b.at for b in read.blocks]
    tokens = np.concatenate([np.array([tag_token(path) for _, path in read.tags], np.int64), text_tokens(read.blocks)])
    return tokens[np.argsort(places, kind="stable")] if len(tokens) else tokens


def host_of(url):
    """The host of a URL column, in lower case; '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [token_sequence(page) for page in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.int64()))], ["host", "tokens"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, token, n, place) for each token of (host, page, tokens), and token 0, the page itself, once on every page."""
    for batch in batches:
        hosts, pages, columns = [], [], []
        for i, sequence in enumerate(batch.column(2)):
            tokens, first, n = np.unique(np.array(sequence.as_py(), np.int64), return_index=True, return_counts=True)
            columns.append([np.append(tokens, 0), np.append(n, 1), np.append(first, -1)])
            hosts.append(np.full(len(tokens) + 1, i))
        at = pa.array(np.concatenate(hosts)) if hosts else pa.array([], pa.int64())
        rest = [pa.array(np.concatenate([c[k] for c in columns]) if columns else [], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *rest], ["host", "page", "token", "n", "place"])


def different_pages(pages: DataFrame) -> DataFrame:
    """(host, page, tokens): the token sequences of pages (host, html), each once however often its content is repeated; page is its hash."""
    read = pages.select("host", "html").mapInArrow(_sequences, "host string, tokens array<long>")
    return cut(read.withColumn("page", F.xxhash64("tokens")).dropDuplicates(["host", "page"]).select("host", "page", "tokens"))


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """(host, class, is_root, tokens): the classes of tokens that may be a template's, from (host, page, tokens).

    A token's occurrence vector has its number on each page of the host. Tokens with
    one vector are an equivalence class. Vectors are never gathered: a vector is known
    by its number of pages and a sum of hashes of (page, occurrences), which Spark
    adds up in parts, so a host of any size is summed like any other. Kept are classes
    of CLASS_SIZE tokens or more with tags among them, on SUPPORT of the different
    pages of a host that has at least LEAST_PAGES; the root is that of tokens that are
    once on every page.
    """
    seen = pages.mapInArrow(_occurrences, "host string, page long, token long, n long, place long")
    rows = seen.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")).alias("vector"), F.min("place").alias("low"))
    rows = cut(rows.filter(F.col("pages") >= LEAST_PAGES))
    hosts = rows.filter("token = 0").select("host", F.col("pages").alias("total"), F.col("vector").alias("root"))
    frequent = rows.filter("token != 0").join(hosts, "host").filter(F.col("pages") >= SUPPORT * F.col("total"))
    classes = frequent.groupBy("host", F.xxhash64("vector", "pages").alias("class"), (F.col("vector") == F.col("root")).alias("is_root")).agg(F.array_sort(F.collect_list(F.struct("low", "token"))).alias("tokens"))
    classes = classes.withColumn("tokens", F.transform("tokens", lambda t: t["token"]))
    return cut(classes.filter((F.size("tokens") >= CLASS_SIZE) & F.exists("tokens", lambda t: t % 2 == 0)))


def _small(df: DataFrame, arrays: str) -> DataFrame:
    """df with a broadcast hint if its arrays of longs take BROADCAST_BYTES at most; beyond that its join shuffles."""
    size = df.agg(F.sum(64 + 8 * F.size(arrays))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, template): the tokens of each host's template, from pages (host, html).

    Equivalence classes are held against every different page: a valid class has its
    tokens in one order, over and over, on each page, and each round of it lies between
    two neighbours of the root class, in which it nests. The template is the root with
    the classes that nest in it. Hosts without a root have none.
    """
    sequences = different_pages(pages)
    classes = equivalence_classes(sequences)
    # classes of one host: at most what its pages' tokens are, one page's worth
    by_host = classes.groupBy("host").agg(F.collect_list(F.struct("class", "is_root", "tokens")).alias("classes"), F.flatten(F.collect_list("tokens")).alias("all"))
    by_host = cut(by_host.filter(F.exists("classes", lambda c: c["is_root"])))
    checked = sequences.join(_small(by_host, "all"), "host")
    broken = checked.select("host", "tokens", "classes").mapInArrow(_broken_classes, "host string, class long").distinct()
    valid = classes.join(by_host.select("host"), "host", "left_semi").join(broken, ["host", "class"], "left_anti")
    return valid.groupBy("host").agg(F.bool_or("is_root").alias("rooted"), F.flatten(F.collect_list("tokens")).alias("template")).filter("rooted").select("host", "template")


def _broken_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, class) of classes that a page (host, tokens, classes) shows not to keep their order or not to nest."""
    for batch in batches:
        out = set()
        for host, tokens, classes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            sequence = np.array(tokens.as_py(), np.int64)
            root = next(c["tokens"] for c in classes if c["is_root"])
            fence = np.flatnonzero(np.isin(sequence, root))
            for c in classes:
                at = np.flatnonzero(np.isin(sequence, c["tokens"]))
                rounds, rest = divmod(len(at), len(c["tokens"]))
                if rest or not np.array_equal(sequence[at], np.tile(c["tokens"], rounds)):
                    out.add((host, c["class"]))
                elif rounds and not c["is_root"]:
                    tuples = at.reshape(rounds, -1)
                    if (np.searchsorted(fence, tuples[:, 0]) != np.searchsorted(fence, tuples[:, -1])).any():
                        out.add((host, c["class"]))
        hosts, broken = zip(*sorted(out), strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(broken, pa.int64())], ["host", "class"])


def _size(blocks: list[Block]) -> int:
    return sum(len(b.text) for b in blocks)


def _slots(page: str, template: set[int]) -> tuple[Page, list[Block], bool]:
    """The blocks that neither furniture nor the template takes, and whether the page marks its article."""
    read = read_page(page, template)
    blocks = [b for b in read.blocks if not b.furniture]
    level = max((b.article for b in blocks), default=0)
    marked = level > 0
    if marked:  # an article within the main part is it, with headings of that part before it
        first = next(b.at for b in blocks if b.article == level)
        blocks = [b for b in blocks if b.article == level or (b.article and b.heading and b.at < first)]
    if template:
        slots = [b for b, token in zip(blocks, text_tokens(blocks).tolist(), strict=True) if token not in template]
        if 2 * _size(slots) >= _size(blocks) or not marked:
            blocks = slots
    return read, blocks, marked


def main_parts(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """(host, main): of the template's elements that hold parts of a page, the one with most text of slots over all the host's pages that mark no article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: Counter[tuple[str, int]] = Counter()
            for host, page, template in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                read, blocks, marked = _slots(page.as_py(), frozenset(template))
                if not marked:
                    for b in blocks:
                        sums[host, read.containers[b.container][1]] += len(b.text)
            hosts, parts = zip(*sums, strict=True) if sums else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(parts, pa.int64()), pa.array(list(sums.values()), pa.int64())], ["host", "part", "chars"])

    unmarked = pages.filter(~F.regexp_like("html", F.lit(r"(?i)<(?:article|main)\b"))).join(_small(templates, "template"), "host")
    found = unmarked.select("host", "html", "template").mapInArrow(run, "host string, part long, chars long")
    return found.groupBy("host", "part").agg(F.sum("chars").alias("chars")).groupBy("host").agg(F.max_by("part", F.struct("chars", "part")).alias("main"))


def main_text(page: str | None, template: set[int] = frozenset(), main: int | None = None) -> str:
    """The text of the slots that the template leaves and that are the article.

    Text of the template goes: what every page of the host says is not this page's
    article. Where that would be most of a marked article, the pages are copies of one
    article rather than made from one form, and it stays. Of the slots left, furniture
    elements go. In a page that marks no article, the slots are dealt to the elements of
    the template that hold them, and the host's main one is the article (or that with
    most text, if the page lacks it), with what is nested in it and with headings.
    """
    read, blocks, marked = _slots(page or "", template)
    if not marked and len(read.containers) > 1 and blocks:
        best = next((i for i, (_, token) in enumerate(read.containers) if token == main and main is not None), None)
        if best is None:
            best = int(np.bincount([b.container for b in blocks], [len(b.text) for b in blocks], len(read.containers)).argmax())
        inside = [False] * len(read.containers)
        for c, (parent, _) in enumerate(read.containers):
            inside[c] = c == best or (c > 0 and inside[parent])
        blocks = [b for b in blocks if inside[b.container] or b.heading]
    return "\n".join(b.text for b in blocks)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (page_id, url, text, n_chars) for each page: its article, block by block.

    Templates are deduced for each host (see deduce_templates) and joined back to
    the pages: broadcast behind a check of their bytes, by a join on the host beyond
    that, which adaptive execution splits for a host with a great share of all pages.
    Extraction then is a map over whole pages.

    Edge cases: null and empty html give '' and 0; pages without a host share the
    host ''; broken markup is read to its end in time proportional to its length, long
    pages too; repeated pages are extracted each, and count once in deducing a template;
    hosts of fewer than LEAST_PAGES different pages have no template, which needs
    several pages to be seen, and are cleaned by their elements alone; other columns
    are ignored, whatever their names.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    templates = cut(deduce_templates(rows))
    templates = cut(templates.join(main_parts(rows, templates), "host", "left"))
    joined = rows.join(_small(templates, "template"), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, frozenset[int]] = {}
            texts = []
            for page, template, main in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                texts.append(main_text(page.as_py(), known.setdefault(tuple(template), frozenset(template)) if template else frozenset(), main))
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "template", "main").mapInArrow(run, "page_id long, url string, text string, n_chars long")
