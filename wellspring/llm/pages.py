"""Main text of web pages by paths that the pages of a host agree on.

Every page scores its containers by the text they hold, less links and less
what menus, adverts and the like hold, and votes for the generalised tag and
class paths of its best ones. Spark sums the votes by host; each page is then
extracted again along its host's winning path.
"""

import html as entities
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from . import common

#: HTML's elements by what they mean here.
RAW = "script style noscript template iframe object svg canvas textarea select option button audio video head title".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCK = (
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote "
    "figure figcaption address details summary fieldset form nav aside header footer hgroup center dialog menu search hr legend"
).split()
CONTAINER = "body main article section div td center".split()
DROPPED = "nav aside footer form dialog menu search fieldset".split()
#: Words in classes, ids and roles of what is no main text.
NOISE = (
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert "
    "popup modal overlay newsletter subscribe subscription signup sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs masthead "
    "footer comment comments commentlist disqus respond replies share sharing social related recommended recommendations pagination pager toolbar "
    "search login copyright contentinfo complementary hidden dialog outbrain taboola skip skiplink"
).split()
#: Words that stand beside those in names of the same things.
FILLERS = (
    "area bar block body bottom box btn button buttons col column container content desktop div footer form global group head header home icon icons inner item "
    "items layout left link links list local lower main mobile module nav outer page pane panel post posts primary right row secondary section site slot small "
    "sticky stories tab tabs title top unit upper wrap wrapper"
).split()
ARTICLE_WORDS = "article content entry main post story text".split()
_raw, _void, _block, _container, _dropped, _noise, _good = map(frozenset, (RAW, VOID, BLOCK, CONTAINER, DROPPED, NOISE, ARTICLE_WORDS))
_beside = _noise | frozenset(FILLERS)

_token = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S
)
_attribute = re.compile(r"""([^\s"'=<>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def names_noise(names: str, inside: bool) -> bool:
    """Whether a class, id or role names what is no main text.

    Outside an article any noise word in a name tells. Inside one a name must
    consist of such words, with fillers at most beside them: share-buttons is
    noise there, share-price is not.
    """
    for name in names.split():
        words = {w.lower() for w in _parts.findall(name) if not w.isdigit()}
        if not words.isdisjoint(_noise) and (not inside or words <= _beside):
            return True
    return False


class Element:
    """An open or closed container with what was gathered below it."""

    __slots__ = ("tag", "path", "noise", "inside", "content", "noise_chars", "good", "first", "last")

    def __init__(self, tag: str, path: str, noise: bool, inside: bool, good: float, first: int):
        self.tag, self.path, self.noise, self.inside, self.good = tag, path, noise, inside, good
        self.content = self.noise_chars = 0.0
        self.first = self.last = first


def _open(tag: str, attributes: str, parent: Element, at: int) -> Element:
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attribute.finditer(attributes)} if "=" in attributes else {}
    names = f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}"
    words = {w.lower() for w in _parts.findall(names)}
    inside = parent.inside or tag in ("article", "main")
    noise = parent.noise or tag in _dropped or tag not in ("html", "body", "main", "article") and names_noise(names, parent.inside)
    noise = noise or not inside and (tag == "header" or "header" in words and tag not in ("html", "body"))
    flat = a.get("style", "").replace(" ", "").lower()
    noise = noise or a.get("aria-hidden") == "true" or "display:none" in flat or bool(re.search(r"(?:^|\s)hidden(?=\s|=|/|$)", attributes))
    step = tag + "".join(f".{re.sub(r'[0-9]+', '#', c)}" for c in sorted(set(a.get("class", "").lower().split())))
    good = {"article": 0.2, "main": 0.1, "html": -0.3, "body": -0.2}.get(tag, 0.0)
    if tag not in ("article", "main", "html", "body") and not words.isdisjoint(_good):
        good += 0.1
    return Element(tag, f"{parent.path}>{step}" if parent.path else step, noise, inside, good, at)


def parse(html: str) -> tuple[list[tuple[str, bool, float]], list[Element]]:
    """Text blocks (text, is noise, characters in links) in page order, and all containers.

    Never fails: tags left open end with their parent, end tags without a start
    are passed over, and an unclosed comment, tag or script runs to the end.
    """
    root = Element("", "", False, False, -1.0, 0)
    stack, blocks, containers = [root], [], []
    text: list[str] = []
    linked = link_depth = 0
    pos, end = 0, len(html)

    def flush():
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                top = stack[-1]
                share = min(1.0, linked / len(joined))
                blocks.append((joined, top.noise, share))
                for e in stack:
                    if top.noise:
                        e.noise_chars += len(joined)
                    else:
                        e.content += len(joined) * (1 - share)
            text.clear()
        linked = 0

    def close(n: int):
        while len(stack) > n:
            stack.pop().last = len(blocks)

    while pos < end:
        m = _token.search(html, pos)
        stop = m.start() if m else end
        if stop > pos:
            piece = entities.unescape(html[pos:stop])
            text.append(piece)
            if link_depth:
                linked += len(piece.strip())
        if not m:
            break
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if tag in _raw:
            if not closing and not attributes.endswith("/"):
                done = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, pos)
                pos = done.end() if done else end if tag in ("script", "style", "textarea", "title") else pos
            text.append(" ")
        elif tag in ("br", "wbr"):
            text.append(" " if tag == "br" else "")
        elif tag == "a":
            link_depth = 0 if closing else 1
        elif tag in _block:
            flush()
            link_depth = 0
            if tag in _void:
                continue
            if closing:
                found = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                if found:
                    close(found)
                continue
            top = stack[-1].tag
            if top == "p" or top == tag and tag in ("li", "dt", "dd", "td", "th", "tr") or top in ("dt", "dd") and tag in ("dt", "dd"):
                close(len(stack) - 1)
            stack.append(_open(tag, attributes or "", stack[-1], len(blocks)))
            if tag in _container:
                containers.append(stack[-1])
    flush()
    close(0)
    return blocks, containers


def container_score(e: Element) -> float:
    """Text of a container, weighed by its kind, less half of the noise that it holds."""
    return 0.0 if e.noise else e.content * (1 + e.good) - 0.5 * e.noise_chars


def ballots(containers: list[Element], votes: int = 3) -> list[tuple[str, float]]:
    """Paths of the page's best containers with weights from 1 down; equal paths count together."""
    total: dict[str, float] = {}
    for e in containers:
        s = container_score(e)
        if s > 0:
            total[e.path] = total.get(e.path, 0.0) + s
    best = sorted(total.items(), key=lambda x: (-x[1], -len(x[0]), x[0]))[:votes]
    return [(p, s / best[0][1]) for p, s in best]


def extract(html: str, paths: list[str] | None = None) -> tuple[str, str | None]:
    """Main text along one of paths, and the path used.

    Of several paths with text the page takes that on which its own containers
    score best, ties to the one named first; without any, its own best path. A
    page without any container gives all its blocks that are no noise.
    """
    blocks, containers = parse(html)
    score: dict[str, float] = {}
    for e in containers:
        score[e.path] = score.get(e.path, 0.0) + max(container_score(e), 0.0)
    agreed = sorted((p for p in paths or () if p in score), key=lambda p: -score[p])
    for p in agreed + [x for x, _ in ballots(containers, 1)]:
        kept, last = [], 0
        for e in containers:
            if e.path == p and not e.noise:
                kept += [t for t, noise, _ in blocks[max(e.first, last) : e.last] if not noise]
                last = max(last, e.last)
        if kept:
            return "\n".join(kept), p
    return "\n".join(t for t, noise, _ in blocks if not noise), None


def host_of(url) -> "F.Column":
    """Host of a URL in lower case; empty if there is none."""
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(found, F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: float = 0.05) -> DataFrame:
    """(host, path, weight, place) of the winning paths of each host; ties go to the longer, then the smaller path.

    A path wins with a share of least of its host's votes, so a host of several
    templates has several, but no more than 1 / least; where votes are spread
    thinner the heaviest wins. Pages without a host do not vote.
    """
    src = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("text"))

    def run(rows):
        out = {"host": [], "path": [], "weight": []}
        for host, h in zip(rows["host"], rows["text"]):
            for path, weight in ballots(parse(h)[1]) if h else []:
                for k, v in zip(out, (host, path, weight)):
                    out[k].append(v)
        return out

    cast = common.map_text_chunks(src.where("host <> ''"), run, "host string, path string, weight double", "text")
    sums = durable(cast.groupBy("host", "path").agg(F.round(F.sum("weight"), 6).alias("weight")))
    total = sums.groupBy("host").agg(F.sum("weight").alias("all"), F.max("weight").alias("most"))
    agreed = sums.join(total, "host").where((F.col("weight") >= least * F.col("all")) | (F.col("weight") == F.col("most")))
    order = Window.partitionBy("host").orderBy(F.desc("weight"), F.desc(F.length("path")), "path")
    ranked = agreed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 1 / least)
    return ranked.select("host", "path", "weight", "place")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, path) of every page; text is empty where there is none.

    Null html counts as empty; a page with a null or odd URL follows its own best
    path; long pages are taken whole; repeated rows count each; an empty table
    gives no rows; other columns are not read. Votes are added up before they
    move, and the join with the winners brings one short row for each host, so a
    host with a third of all pages costs no more than others.
    """
    winners = host_paths(pages, url_col, html_col).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("w"))
    winners = winners.select("host", F.transform("w", lambda x: x["path"]).alias("paths"))
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("text"), host_of(F.col(url_col)).alias("host"))
    src = src.join(winners, "host", "left").select("id", "url", "text", "paths")
    kind = src.schema["id"].dataType.simpleString()

    def run(rows):
        found = [extract(h, p) if h else ("", None) for h, p in zip(rows["text"], rows["paths"])]
        return {"id": rows["id"], "url": rows["url"], "main": [t for t, _ in found], "path": [p for _, p in found]}

    out = common.map_text_chunks(src, run, f"id {kind}, url string, main string, path string", "text")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("main").alias("text"), "path")
