"""Main text of web pages, by deduction of each host's template.

A page is read as tokens: its containers, each known by its path from the root (names and roles, numbers of two digits or more aside), and its
text blocks, each in the container that holds it. Over the pages of a host every token has an occurrence vector (how often
it stands in each page), summed into an order-free signature. The tokens of one signature form an equivalence class; a
class is valid if its support is large enough and its tokens do not repeat within pages at random.

Containers of valid classes, nested by their paths, are the host's template; the slot of a block is the innermost of them
around it. What is left in the slots once valid blocks are taken out is their mass, over all pages of the host. The
template says which slots make the text: without parts whose role or tag speaks of menus, headers, footers, asides,
notices, adverts, forms or comments, and parts that are mostly links, it is the article's or main element's subtree, or,
where the host marks none, the innermost container that holds most of the mass. A role alone can't rule out a slot that
holds most of its host's mass. Pages only look their blocks up: a block is text if its slot is of those and the block is
not itself template. A page with no block in the slots, being unlike its host, is read by a template of its own.

Signatures and masses are sums, so a host with a third of all pages is counted by every task and merged; only its
template, not its pages, is ever gathered. Templates go to the pages by a join on host, broadcast up to a checked size.

Defined results: null or empty html gives an empty text; pages without a host form one group; blocks are template from
LEAST_PAGES pages on, so that few pages, or copies of one, don't erase one another; a null id stays null; repeated rows are
extracted one by one, and count once each in the template; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import common

#: A class of blocks is valid from so many pages on, and any class from this share of its host's pages.
LEAST_PAGES, LEAST_SHARE = 4, 0.3
#: A container is gone into while it holds this part of the mass.
MOST_OF = 0.6
#: Template keys (8 bytes each) that may be broadcast.
BROADCAST_TOKENS = 500_000

# How elements are told apart.
RAW = frozenset("script style noscript template textarea svg iframe title".split())
DROPPED = frozenset("head nav header footer aside form button select menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html head body nav header footer aside form main article section div ul ol table dialog menu figure details blockquote button select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNWANTED = re.compile(
    r"(ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|side-?bar|footer|header|masthead|cookies?|consent|notice|alert|pop-?up|modal|newsletter|subscribe|signup|login|share|social|recommend\w*|comments?|repl(?:y|ies)|disqus|respond|pagination|pager|widget|toolbar|skip)([-_].*)?"
    r"|related([-_](posts?|articles?|links?|stories|items?|reading|news|topics?|content|pages?))?"
    r"|(?!with|has|no|without|is|main|article|entry|post)[a-z]+[-_](ads?|nav|menu|side-?bar|footer|header|notice|comments?|share|banner|promo|widget)",
    re.I,
)
TEXTUAL = re.compile(r"(main|article|post|entry|story|page)?[-_]?(content|text|body|article)", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ROLE = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: What a container's tag and role say: a tag of unwanted parts, an unwanted role, nothing, an article.
TAG, ROLE, NONE, ARTICLE = -2, -1, 0, 1


def _role(attributes: str) -> str:
    return " ".join(a or b or c for a, b, c in _ROLE.findall(attributes)) if "=" in attributes else ""


def _digest(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(errors="replace"), digest_size=8).digest(), "little", signed=True)


class Node:
    """A container: its key, those of the containers around it and its own, and what tag and role say."""

    __slots__ = ("name", "path", "hint")

    def __init__(self, name: str, label: str, above: Node | None, hint: int) -> None:
        self.name, self.hint = name, hint
        self.path = (*above.path, _digest(f"{above.path[-1]}/{label}")) if above else (0,)


ROOT = Node("", "", None, NONE)


def read(page: str, memo: dict) -> tuple[list[Node], list[tuple[str, tuple[int, ...], int, int]]]:
    """The containers, and the blocks as (text, path, words, words in links)."""
    nodes: list[Node] = []
    blocks: list[tuple[str, tuple[int, ...], int, int]] = []
    stack: list[Node] = [ROOT]
    parts: list[str] = []
    linked, in_link, heading = 0, False, False

    def end() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            at = len(stack) - 1
            if heading:  # an article's own title may stand in its header
                for k, node in enumerate(stack):
                    if node.name == "header" and any(x.hint == ARTICLE for x in stack[:k]):
                        at = k - 1
                        break
            n = text.count(" ") + 1
            blocks.append((text, stack[at].path, n, min(linked, n)))
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        parts.append(piece)
        if in_link:
            linked += len(piece.split())
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:-3])
            continue
        name = name.lower()
        if name in RAW:
            if not m[1]:
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if name == "a":
            in_link = not m[1]
        if name in BLOCKS:
            end()
            in_link = in_link and not m[1]
            if name in HEADINGS:
                heading = not m[1]
        if name not in CONTAINERS:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            continue
        role = _role(m[3])
        above = stack[-1]
        if name == "body" or (name in ("article", "main") and not any(s.name in ("article", "main") for s in stack)):
            above = next((s for s in stack if s.name == "body"), ROOT)  # an element left open before can't hide the article
        known = (above.path, name, role)
        if known not in memo:
            words = role.split()
            article = name in ("article", "main") or "articlebody" in role.lower()
            bad = name not in ("html", "body") and any(UNWANTED.fullmatch(w) for w in words) and not any(TEXTUAL.fullmatch(w) for w in words)
            hint = TAG if name in DROPPED else ROLE if bad else ARTICLE if article else NONE
            memo[known] = Node(name, name + "." + re.sub(r"[0-9]{2,}", "#", role), above, hint)
        node = memo[known]
        stack.append(node)
        nodes.append(node)
    end()
    return nodes, blocks


def _block(path: tuple[int, ...], text: str) -> int:
    return _digest(f"{path[-1]}:{text}")


def main_slots(nodes: dict[int, tuple[tuple[int, ...], int, int, int]]) -> tuple[set[int], bool]:
    """nodes: key to (path, hint, mass, words in links). The slots that make the text, and whether an article is marked."""
    parent = {k: next((p for p in reversed(v[0][:-1]) if p in nodes), None) for k, v in nodes.items()}
    order = sorted(nodes, key=lambda k: (len(nodes[k][0]), k))
    mass, links = {k: v[2] for k, v in nodes.items()}, {k: v[3] for k, v in nodes.items()}
    for k in reversed(order):
        if parent[k] is not None:
            mass[parent[k]] += mass[k]
            links[parent[k]] += links[k]
    whole = sum(v[2] for v in nodes.values())
    bad: set[int] = set()
    for k in order:
        hint = nodes[k][1]
        ruled_out = hint == TAG or (hint == ROLE and 2 * mass[k] <= whole) or 2 * links[k] > mass[k] + links[k]
        if parent[k] in bad or (ruled_out and k != 0):
            bad.add(k)
    wanted = {k: 0 if k in bad else nodes[k][2] for k in order}
    for k in reversed(order):
        if parent[k] is not None:
            wanted[parent[k]] += wanted[k]
    children: dict[int, list[int]] = {}
    for k in order:
        if parent[k] is not None and k not in bad:
            children.setdefault(parent[k], []).append(k)
    marked = [k for k in order if nodes[k][1] == ARTICLE and wanted[k] and k not in bad]
    tops = [k for k in marked if not set(nodes[k][0][:-1]) & set(marked)]
    if tops:
        while len(tops) == 1:
            inner = [k for k in marked if parent[k] == tops[0] and wanted[k] >= MOST_OF * wanted[tops[0]]]
            if not inner:
                break
            tops = inner
    else:
        at = order[0] if order else 0
        while True:
            best = max(children.get(at, ()), key=lambda k: (wanted[k], -k), default=None)
            if best is None or not wanted[best] or wanted[best] < MOST_OF * wanted[at]:
                break
            at = best
        tops = [at]
    inside = set(tops)
    return {k for k in order if k not in bad and inside & set(nodes[k][0])}, bool(marked)


def _own_slots(nodes: list[Node], blocks: list[tuple[str, tuple[int, ...], int, int]]) -> set[int]:
    """The slots of one page by itself."""
    found = {0: [(0,), NONE, 0, 0]}
    for node in nodes:
        found.setdefault(node.path[-1], [node.path, node.hint, 0, 0])
    for _, path, words, linked in blocks:
        row = found[path[-1]]
        row[2] += words - linked
        row[3] += linked
    return main_slots({k: tuple(v) for k, v in found.items()})[0]


COUNTED = "host string, kind int, token long, path array<long>, hint int, pages long, vector long, most long, mass long, linked long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host and token of a batch: pages, sum of (page, count) hashes, most in a page, words. Kind 0 stands for the
    page itself, 1 are containers, 2 blocks, 3 containers as slots of blocks."""
    for batch in batches:
        seen: dict[tuple[str, int, int], list] = {}
        memo: dict = {}
        for page, host, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            nodes, blocks = read(text, memo)
            counts: dict[tuple[int, int], list] = {(0, 0): [1, (0,), NONE, 0, 0], (1, 0): [1, (0,), NONE, 0, 0]}
            for node in nodes:
                counts.setdefault((1, node.path[-1]), [0, node.path, node.hint, 0, 0])[0] += 1
            for block, path, words, linked in blocks:
                for kind, token in ((2, _block(path, block)), (3, path[-1])):
                    row = counts.setdefault((kind, token), [0, path, NONE, 0, 0])
                    row[0] += 1
                    row[3] += words - linked
                    row[4] += linked
            for (kind, token), (count, path, hint, words, linked) in counts.items():
                row = seen.setdefault((host, kind, token), [path, hint, 0, 0, 0, 0, 0])
                row[2] += 1
                row[3] = row[3] + _digest(f"{page}:{count}") & (1 << 60) - 1
                row[4] = max(row[4], count)
                row[5] += words
                row[6] += linked
        keys, rows = list(seen), list(seen.values())
        ints = lambda i: pa.array([r[i] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64()), pa.array([list(r[0]) for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.int32()), *(ints(i) for i in range(2, 7))],
            names=["host", "kind", "token", "path", "hint", "pages", "vector", "most", "mass", "linked"],
        )


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hosts' templates: all container keys, those of the text's slots, and the blocks that are template."""
    for batch in batches:
        out: list[tuple] = []
        for host, nodes, blocks in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            slots, marked = main_slots({x["key"]: (tuple(x["path"]), x["hint"], x["mass"], x["linked"]) for x in nodes})
            out.append((host, [x["key"] for x in nodes], sorted(slots), [b["token"] for b in blocks or () if b["fixed"] or not marked]))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), *(pa.array([o[i] for o in out], pa.list_(pa.int64())) for i in (1, 2, 3))], names=["host", "nodes", "slots", "blocks"])


TEMPLATE = "host string, nodes array<long>, slots array<long>, blocks array<long>"


def templates(pages: DataFrame) -> DataFrame:
    """pages: (page, host, html). One row per host, as TEMPLATE says."""
    counted = common.map_arrow(pages, _counted, COUNTED)
    vector = F.sum((F.col("vector") % (1 << 40)).cast("decimal(38,0)")) % F.lit(1 << 40).cast("decimal(38,0)")
    tokens = counted.groupBy("host", "kind", "token").agg(F.min("path").alias("path"), F.min("hint").alias("low"), F.max("hint").alias("high"), F.sum("pages").alias("pages"), vector.cast("long").alias("vector"), F.max("most").alias("most"), F.sum("mass").alias("mass"), F.sum("linked").alias("linked"))
    tokens = common.settle(tokens.where(f"pages >= {LEAST_PAGES} or kind <> 2"), "page-tokens")
    whole = tokens.where("kind = 0").select("host", F.col("pages").alias("of"))
    known = tokens.where("kind in (1, 2)")
    classes = known.groupBy("host", "pages", "vector").agg(F.count("*").alias("size"))
    valid = classes.join(whole, "host").where(f"pages >= {LEAST_SHARE} * of and (size > 1 or pages = of or pages >= {2 * LEAST_PAGES})")
    valid = common.settle(known.join(valid, ["host", "pages", "vector"]).select("host", "kind", "token", "path", "low", "high", "mass", "linked", ((F.col("pages") == F.col("of")) & (F.col("of") >= 2 * LEAST_PAGES)).alias("fixed")), "page-classes")
    nodes = valid.where("kind = 1 and token <> 0").select("host", F.col("token").alias("key"), "path", F.when(F.col("low") < 0, F.col("low")).otherwise(F.col("high")).alias("hint"))
    nodes = nodes.unionByName(whole.select("host", F.lit(0).cast("long").alias("key"), F.array(F.lit(0).cast("long")).alias("path"), F.lit(NONE).alias("hint")))
    # what stands in a slot, less its template blocks, belongs to the innermost container of the template around it
    kept = tokens.where("kind = 3").select("host", "path", "mass", "linked").unionByName(valid.where("kind = 2").select("host", "path", (-F.col("mass")).alias("mass"), (-F.col("linked")).alias("linked")))
    slots = kept.groupBy("host", "path").agg(F.sum("mass").alias("mass"), F.sum("linked").alias("linked"))
    placed = slots.select("*", F.posexplode("path").alias("depth", "key")).join(nodes.select("host", "key"), ["host", "key"]).groupBy("host", "path").agg(F.max(F.struct("depth", "key")).alias("d"), F.first("mass").alias("mass"), F.first("linked").alias("linked"))
    masses = placed.groupBy("host", F.col("d.key").alias("key")).agg(F.sum("mass").alias("mass"), F.sum("linked").alias("linked"))
    zero = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c)
    tree = nodes.join(masses, ["host", "key"], "left").groupBy("host").agg(F.collect_list(F.struct("key", "path", "hint", zero("mass"), zero("linked"))).alias("nodes"))
    blocks = valid.where("kind = 2").groupBy("host").agg(F.collect_list(F.struct("token", "fixed")).alias("blocks"))
    return common.map_arrow(tree.join(blocks, "host", "left").select("host", "nodes", "blocks"), _decided, TEMPLATE)


def main_text(page: str, nodes: frozenset[int], slots: frozenset[int], template: frozenset[int], memo: dict) -> str:
    found, blocks = read(page, memo)
    taken = []
    for text, path, _, _ in blocks:
        slot = next((k for k in reversed(path) if k in nodes), None)
        if slot in slots and _block(path, text) not in template:
            taken.append(text)
    if not taken and blocks:
        own = _own_slots(found, blocks)
        taken = [b[0] for b in blocks if b[1][-1] in own and _block(b[1], b[0]) not in template]
    return " ".join(taken)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, sets = None, (frozenset(),) * 3
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part, memo = batch.slice(i, 512), {}
            texts = []
            for text, host, *lists in zip(*(part.column(k).to_pylist() for k in range(2, 7)), strict=True):
                if (host, lists) != last:
                    last, sets = (host, lists), tuple(frozenset(x or ()) for x in lists)
                texts.append(main_text(text, *sets, memo))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of each row."""
    host = F.coalesce(F.regexp_extract(F.lower(url_col), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(html_col, F.lit("")).alias("html"))
    found = common.settle(templates(rows.select(F.monotonically_increasing_id().alias("page"), "host", "html")), "page-templates")
    size = found.agg(F.sum(F.size("nodes") + F.size("slots") + F.size("blocks"))).first()[0] or 0
    wide = rows.join(F.broadcast(found) if size <= BROADCAST_TOKENS else found, "host", "left")
    return common.map_arrow(wide.select("page_id", "url", "html", "host", "nodes", "slots", "blocks"), _extracted, "page_id long, url string, text string")


def op4_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(common.table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
