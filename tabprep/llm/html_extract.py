"""Main text of web pages by equivalence-class template deduction.

Every page is read as tokens: tags with the path of elements they lie in, and the
texts between them.  A token's occurrence vector says how often each page of
the host has it.  Vectors are compared by signature, a sum over pages of a hash of
the page times the count, which is aggregated with a map-side combine, so a host
that holds a third of all pages is never gathered.  Tokens of a host with equal
vectors form an equivalence class.  A class is accepted or rejected whole: it needs tags and
enough pages, and it must nest, that is, lie in one other valid class.  The valid classes, with the texts
in them that all pages have, are the host's template; what lies between its tags are the slots.

Slots under elements for menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments are boilerplate.  A class or id marks boilerplate only as a whole token or id.
The pages are read again, and the text in the slots of each container of the template is counted, without
the template's own text.  The main slot is the deepest container that covers nearly all of it, titles included.
It is widened or narrowed to the template's ``article``, else its ``main``, if it lies in that or half of its
text does; nothing inside these is dropped but nested boilerplate.  Out of other main slots the template's own text is
left too.  A page that has the main slot is read from it, unless most of the text is in an article or main of its own.
A page of a host without a template is read from its own articles, else mains.  A page whose articles or mains all lie below
marked elements is read from these, if they hold at least as much text as the rest; marks on their ancestors do not count.
The blocks of the main slot give the text.

Defined cases: NULL or empty html gives an empty text; a page without a main slot
gives the text of its body without boilerplate; repeated rows give a row each;
an empty table gives no rows; other columns are not read; an unclosed or unknown tag
is tolerated; elements nested more than ``DEPTH`` deep count as part of the one around them at that depth.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of, materialize

MIN_PAGES = 3
MIN_SHARE = 0.5
COVER = 0.95
DEPTH = 512
#: Templates are broadcast if all their paths and hashes together take at most this many bytes.
BROADCAST_BYTES = 32_000_000

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
                   "p pre section summary table tbody td tfoot th thead tr ul".split())
BOILERPLATE = frozenset("nav header footer aside form script style noscript template iframe button select option "
                        "textarea input menu dialog svg canvas object embed head title noembed noframes xmp".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Whole class tokens or ids that mark boilerplate.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo banner nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs header masthead footer sidebar aside notice notices cookie cookies consent gdpr popup modal "
    "overlay newsletter subscribe signup login comment comments disqus reply replies respond share sharing social related "
    "recommended widget pagination pager toolbar main-nav main-menu nav-menu site-nav site-header site-footer page-header "
    "page-footer cookie-banner cookie-notice cookie-consent share-buttons social-share social-links related-posts "
    "related-articles comment-list comments-area comment-form disqus_thread".split())
#: Elements that can be the main slot.
CONTAINERS = ("article", "body", "center", "dd", "div", "main", "section", "table", "tbody", "td", "tr")
NAMED = ("article", "main")
#: An end tag of another name does not close elements outside these.
BARRIERS = ("article", "main", "body", "table")
#: A start tag of these closes an open paragraph.
CLOSES_P = BLOCKS - {"body", "html", "caption", "legend", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
NAME = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def is_boilerplate(tag: str, attributes: str) -> bool:
    if tag in BOILERPLATE:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in NAME.findall(attributes):
        value = "".join(values).lower()
        words = [value.strip()] if name.lower() == "id" else value.split()
        known = BOILERPLATE_ROLES if name.lower() == "role" else BOILERPLATE_WORDS
        if any(w in known for w in words):
            return True
    return False


def label(tag: str, attributes: str) -> str:
    """A tag as a step of a path: with its class, which tells elements of a template apart."""
    for name, *values in NAME.findall(attributes) if attributes else ():
        if name.lower() == "class" and "".join(values):
            return f"{tag}.{'.'.join(sorted(''.join(values).split()))}".replace("/", "|")  # "/" parts the steps of a path
    return tag


def tokens(page: str):
    """(kind, tag, path, boilerplate, text): kind is open, close, void or text; path is that of the element; boilerplate
    is the length of the path of the innermost boilerplate element around, or 0."""
    stack: list[tuple[str, str, int]] = []  # (tag, path, boilerplate)
    opened: Counter = Counter()  # the tags of the stack

    def leave(i: int):
        opened.subtract(x[0] for x in stack[i:])
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        found, start = None, at
        while not found:  # a "<" that starts no tag is text
            start = page.find("<", start)
            if start < 0:
                break
            found = TOKEN.match(page, start)
            start += 1
        text = page[at:found.start()] if found else page[at:]
        if text:
            _, path, bad = stack[-1] if stack else ("", "", 0)
            yield "text", "", path, bad, text
        if not found:
            return
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:  # an end tag closes the nearest open element of its name, and what is open inside it
            free = tag in ("body", "html", *NAMED)
            if not opened[tag]:
                if free or not any(opened[b] for b in BARRIERS):
                    yield "void", tag, stack[-1][1] if stack else "", stack[-1][2] if stack else 0, ""
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    yield "close", tag, stack[i][1], stack[i][2], ""
                    leave(i)
                    break
                if stack[i][0] in BARRIERS and not free:
                    break
            continue
        attributes = found[3] or ""
        if tag in CLOSES_P or tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            ends = {"p"} if tag in CLOSES_P else {"p", tag, "dd" if tag == "dt" else "dt" if tag == "dd" else tag}
            for i in range(len(stack) - 1, -1, -1) if any(opened[t] for t in ends) else ():
                if stack[i][0] in ends:
                    leave(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        _, path, bad = stack[-1] if stack else ("", "", 0)
        if len(stack) < DEPTH:
            path = f"{path}/{label(tag, attributes)}"
        if is_boilerplate(tag, attributes):
            bad = len(path) + (len(stack) >= DEPTH)
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCKS:
            yield "void", tag, path, bad, ""
            continue
        yield "open", tag, path, bad, ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append((tag, path, bad))
        opened[tag] += 1


def host_of(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def signature(page_key: str, n: int) -> int:
    """The page's part of a vector signature, within 31 bits so that the sum over a host's pages stays a long."""
    data = page_key.encode()
    return ((zlib.crc32(data) << 29) ^ zlib.crc32(data[::-1] + b"\x01")) * n % (1 << 31)


def hash_of(text: str) -> int:
    """63 bits that stand for a text, never 0."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1 or 1


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """(host, path, text_hash, n_pages, vector, n_free): a row for each host and token. Tag tokens have the hash 0; a
    text token's hash is that of its text. ``n_free`` of the pages have the path unmarked."""
    ddl = "host string, path string, text_hash long, n_pages long, vector long, n_free long"

    def run(batches):
        for b in batches:
            held: dict[tuple, list[int]] = {}
            for page_id, url, page in zip(*(b.column(i) for i in range(3))):
                url, page = url.as_py(), page.as_py() or ""
                counts: Counter = Counter()
                free: set[str] = set()
                for kind, _, path, bad, text in tokens(page):
                    if kind in ("open", "void"):
                        counts[path, 0] += 1
                        if not bad:
                            free.add(path)
                    elif kind == "text" and not bad and (text := " ".join(text.split())):
                        counts[path, hash_of(text)] += 1
                host, key = host_of(url), f"{page_id.as_py()}|{url}"
                for (path, text_hash), n in counts.items():
                    row = held.setdefault((host, path, text_hash), [0, 0, 0])
                    row[0] += 1
                    row[1] += signature(key, n)
                    row[2] += path in free
            yield from batches_of(((*k, *v) for k, v in held.items()), arrow_schema(ddl), 20000)

    rows = pages.select("page_id", "url", "html").mapInArrow(run, ddl)
    return rows.groupBy("host", "path", "text_hash").agg(
        F.sum("n_pages").alias("n_pages"), F.sum("vector").alias("vector"), F.sum("n_free").alias("n_free"))


def valid_classes(tokens_of: list[tuple[str, int, int, int]]) -> set[tuple[int, int]]:
    """The valid equivalence classes (n_pages, vector) of a host's frequent tokens (path, text_hash, n_pages, vector).
    A class is accepted or rejected whole: it has tags, and it lies in one other valid class, that is, the parents of its
    tags that are not its own belong to one valid class, or there are none."""
    class_of = {path: (n, vector) for path, text_hash, n, vector in tokens_of if not text_hash}
    outer: dict[tuple, set] = defaultdict(set)
    for path, own in class_of.items():
        parent = path.rpartition("/")[0]
        outer[own] |= {class_of.get(parent)} - {own} if parent else set()
    valid = {c for c, of in outer.items() if len(of) <= 1}
    while rejected := {c for c in valid if not outer[c] <= valid}:
        valid -= rejected
    return valid


def named_slot(tags: list[str]) -> str | None:
    """The outermost ``article`` of a template's tags, else its outermost ``main``."""
    for name in NAMED:
        found = [p for p in tags if step_tag(p) == name]
        if found:
            return min(found, key=lambda p: (p.count("/"), p))
    return None


def step_tag(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def deduced(pages: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """(host, path, text_hash, named): the tokens of each host's template; ``named`` marks its article or main."""
    vectors = occurrence_vectors(pages)
    host_pages = pages.groupBy(host_column().alias("host")).agg(F.count(F.lit(1)).alias("host_pages")).filter(
        F.col("host_pages") >= min_pages)
    # A page has at least min_share of a host's frequent tags on average, so their number is bounded by that of a page. A text
    # is the template's own only if all pages have it: a repeated page is no template.
    frequent = vectors.join(host_pages, "host").filter(F.when(F.col("text_hash") == 0, F.col("n_pages") >= min_share * F.col(
        "host_pages")).otherwise(F.col("n_pages") == F.col("host_pages")))
    ddl = "host string, path string, text_hash long, named boolean"

    def run(table):
        import pyarrow as pa

        host, *of = (table.column(c).to_pylist() for c in ("host", "path", "text_hash", "n_pages", "vector", "n_free"))
        of = list(zip(*of))
        valid = valid_classes([x[:4] for x in of])
        kept = [(path, text_hash, 2 * free >= n) for path, text_hash, n, vector, free in of if (n, vector) in valid]
        slot = named_slot([path for path, text_hash, free in kept if free and not text_hash])
        out = [(host[0], path, text_hash, not text_hash and path == slot) for path, text_hash, _ in kept]
        schema = arrow_schema(ddl)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    return frequent.select("host", "path", "text_hash", "n_pages", "vector", "n_free").groupBy("host").applyInArrow(run, ddl)


def slot_chars(pages: DataFrame, template: DataFrame) -> DataFrame:
    """(host, path, chars, titles): unmarked text in the slots of each container of the template, without the template's own text.
    A text counts for the innermost container it lies in; ``titles`` are the characters of it that lie in an h1."""
    ddl = "host string, path string, chars long, titles long"

    def run(batches):
        for b in batches:
            held: dict[tuple, list[int]] = {}
            known: dict[str, tuple[set, set]] = {}
            for host, page, paths, texts in zip(*(b.column(i) for i in range(4))):
                host = host.as_py()
                if host not in known:
                    known[host] = set(paths.as_py()), {(t["path"], t["text_hash"]) for t in texts.as_py()}
                containers, own = known[host]
                for kind, _, path, bad, text in tokens(page.as_py() or ""):
                    if kind == "text" and not bad and (text := " ".join(text.split())) and (path, hash_of(text)) not in own:
                        title = False
                        while path and path not in containers:
                            title |= step_tag(path) == "h1"
                            path = path.rpartition("/")[0]
                        row = held.setdefault((host, path), [0, 0])
                        row[0] += len(text)
                        row[1] += len(text) * title
            yield from batches_of(((*k, *v) for k, v in held.items()), arrow_schema(ddl), 20000)

    rows = pages.select(host_column().alias("host"), "html").join(small_templates(template), "host").select("host", "html", "paths", "texts")
    return rows.mapInArrow(run, ddl).groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.sum("titles").alias("titles"))


def main_slot(slots: list[tuple[str, int, int]], named: str | None = None) -> str | None:
    """The deepest path with at least COVER of the characters, its own and those of the paths in it, and all of the titles;
    ``named``, the template's article or main, if that path lies in it or half of its characters do."""
    sums: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for path, chars, titles in slots:
        while True:
            sums[path][0] += chars
            sums[path][1] += titles
            if not path:
                break
            path = path.rpartition("/")[0]
    chars, titles = sums[""]
    found = [p for p, (n, t) in sums.items() if p and n >= COVER * chars and t == titles]
    widest = max(found, key=lambda p: (p.count("/"), sums[p], p), default="")
    if named and (under(widest, named) or 2 * sums[named][0] >= sums[widest][0]):
        return named
    return widest or None


TEXTS_TYPE = "array<struct<path:string,text_hash:bigint>>"


def small_templates(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its arrays are small: a row is as wide as the template of a host."""
    width = F.lit(64) + F.aggregate("texts", F.lit(0), lambda n, x: n + F.length(x["path"]) + 16)
    if "paths" in df.columns:
        width += F.aggregate("paths", F.lit(0), lambda n, x: n + F.length(x) + 8)
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else df


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, main_path, texts): the path of the main slot in the template of each host that has one. ``texts`` are the
    template's own (path, text_hash) where the main slot is neither an article nor a main."""
    tag = F.regexp_extract("path", "/([a-z0-9]+)[^/]*$", 1)
    template = materialize(deduced(pages, min_pages, min_share).groupBy("host").agg(
        F.collect_list(F.when((F.col("text_hash") == 0) & tag.isin(*CONTAINERS), F.col("path"))).alias("paths"),
        F.collect_list(F.when(F.col("text_hash") != 0, F.struct("path", "text_hash"))).cast(TEXTS_TYPE).alias("texts"),
        F.max(F.when(F.col("named"), F.col("path"))).alias("named")), "page-template")
    ddl = "host string, main_path string"

    def choose(table):
        import pyarrow as pa

        host, named, *slots = (table.column(c).to_pylist() for c in ("host", "named", "path", "chars", "titles"))
        return pa.table([pa.array(c, f.type) for c, f in zip(([host[0]], [main_slot(list(zip(*slots)), named[0])]), arrow_schema(ddl))],
                        schema=arrow_schema(ddl))

    # A row for each container of a template, whose number is bounded by that of a page.
    counted = slot_chars(pages, template).join(template.select("host", "named"), "host")
    chosen = counted.groupBy("host").applyInArrow(choose, ddl).filter("main_path is not null")
    own = F.when(F.regexp_extract("main_path", "/([a-z0-9]+)[^/]*$", 1).isin(*NAMED), F.array().cast(TEXTS_TYPE)).otherwise(F.col("texts"))
    return materialize(chosen.join(template, "host").select("host", "main_path", own.alias("texts")), "page-slots")


def host_column():
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def blocks_under(items: list[tuple], inside) -> list[str]:
    """The blocks of the slots for which ``inside(path, boilerplate)`` holds, in page order."""
    out: list[str] = []
    now: list[str] = []

    def close():
        text = " ".join(htmllib.unescape("".join(now)).split())
        if text:
            out.append(text)
        now.clear()

    for kind, tag, path, bad, text in items:
        if kind == "text":
            if inside(path, bad):
                now.append(text)
        elif tag in BLOCKS:
            close()
        elif tag == "br":
            now.append("\n")
    close()
    return out


def under(path: str, top: str) -> bool:
    return path == top or path.startswith(top + "/")


def marked_slots(items: list[tuple]) -> set[str]:
    """The outermost articles, else mains, of a page that has them only below marked elements. Such a mark does not count, but
    what lies in a menu, an aside or the like is not the page's own article."""
    opened = [(path, tag) for kind, tag, path, _, _ in items if kind == "open" and tag in ("article", "main")]
    opened = [(p, tag) for p, tag in opened if not any(step_tag("/" + x) in BOILERPLATE - {"form"} for x in p.split("/"))]
    found = [p for p, tag in opened if tag == "article"] or [p for p, _ in opened]
    return {p for p in found if not any(p != o and under(p, o) for o in found)}


def main_text(page: str | None, main_path: str | None, texts=frozenset()) -> str:
    """The main text of a page; ``main_path`` is that of its host's template, or None, and ``texts`` the template's own
    (path, text_hash), which are left out of a slot that is neither article nor main."""
    if not page:
        return ""
    items = list(tokens(page))
    opened = [(path, tag) for kind, tag, path, bad, _ in items if kind == "open" and not bad]
    named = {p for p, tag in opened if tag == "article"} or {p for p, tag in opened if tag == "main"}

    def chars(tops: set[str]) -> int:
        return sum(len(" ".join(text.split())) for kind, _, path, bad, text in items
                   if kind == "text" and not bad and any(under(path, t) for t in tops))

    tops = named
    if any(p == main_path for p, _ in opened) and (
            main_path in named or not named or 2 * chars(named) < chars(named | {main_path})):
        tops = {main_path}
    if texts and tops == {main_path}:
        items = [x for x in items if x[0] != "text" or (x[2], hash_of(" ".join(x[4].split()))) not in texts]
    if tops:
        found = blocks_under(items, lambda path, bad: not bad and any(under(path, t) for t in tops))
    else:
        found = blocks_under(items, lambda path, bad: not bad)
    if not named and (marked := marked_slots(items)):
        inner = blocks_under(items, lambda path, bad: any(under(path, t) and bad <= len(t) for t in marked))
        if sum(map(len, inner)) >= sum(map(len, found)):
            found = inner
    return "\n\n".join(found)


def extract(pages: DataFrame, **options) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    found = templates(pages, **options)
    chosen = pages.select("page_id", "url", "html", host_column().alias("host")).join(small_templates(found), "host", "left")
    ddl = "page_id long, url string, text string, n_chars long"

    def run(batches):
        def rows():
            for b in batches:
                for page_id, url, page, main_path, texts in zip(*(b.column(i) for i in range(5))):
                    texts = frozenset((t["path"], t["text_hash"]) for t in texts.as_py() or ())
                    text = main_text(page.as_py(), main_path.as_py(), texts)
                    yield page_id.as_py(), url.as_py(), text, len(text)

        yield from batches_of(rows(), arrow_schema(ddl), 500)

    return chosen.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "main_path", "texts").mapInArrow(run, ddl)
