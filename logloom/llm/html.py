"""Main text of HTML pages by minimum-cut labelling of their text blocks.

A page is read into blocks of text in one forward scan. A linear classifier over plain features (elements and class names
above the block, its own element, share of link text, length, punctuation, digits) gives each block a cost for either label; these costs
are its capacities to the two terminals. Neighbouring blocks are joined by smoothness edges, stronger the nearer they stand in the
element tree, and blocks of one parent are joined over interruptions. A maximum flow (two search trees that stay between augmentations)
finds the cheapest cut, and the blocks left on the source's side are the main text.

The weights of a block's own text and of the class names above it are fitted: fit() takes the blocks whose elements say what they are (inside
article or main; inside nav, header, footer or aside) of at most SAMPLE pages as labelled rows, and finds the logistic weights nearest to a prior. The odds that
elements carry are fixed, and class names are weaker: an element's names are averaged, so one telling word among several others
decides nothing by itself; names that deny or only mention a thing (no-ads, has-sidebar), and those of html and body, say nothing. An element that holds most of
the page's text with its article, main or first heading wraps the page, so neither its names nor its being a form speak against what it holds. The header of an
article is part of it; an article inside another is a reader's comment, and so are siblings of one kind that begin with a short line that is no heading and go on. The list
of telling names covers four languages and is a parameter.

Defined results: a null or empty page, and one without main text, gives an empty text; a tag that is cut off at the end of
a page is dropped; unclosed elements end with their parent; a slash closes only svg and math elements; repeated rows repeat; an empty table gives an
empty result; other columns are kept, whatever their names, but for text and n_chars. Nothing is capped: time grows with the page's length.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.columns import others, quoted

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_INSIDE = re.compile(r"[^>\"']*")
_VALUE = re.compile(r"=\s*\Z")
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACES = re.compile(r"\s+")

#: Fixed values of the HTML standard: elements whose content is raw text, that have no content, and that are inline.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var wbr br input".split()
)
#: Never text of the page.
HIDDEN = frozenset("head script style noscript template svg math canvas object select button textarea iframe".split())
#: What may stand in a head; anything else ends it (fixed values of the HTML standard).
IN_HEAD = frozenset("head title base link meta style script noscript template".split())
#: An opening element of these closes an open one of the same kind, up to the named containers.
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
SCOPES = frozenset("ul ol dl table body html article section div main aside nav header footer blockquote".split())
_END_OF_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

#: Log odds of being main text that elements above a block carry.
ELEMENTS = {
    "article": 5.0, "main": 4.0, "blockquote": 0.5, "pre": 0.5,
    "nav": -8.0, "header": -6.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "menu": -8.0, "dialog": -8.0,
}
#: An article inside an article, and siblings that begin with a byline: readers' comments.
NESTED, BYLINES = -9.0, -7.0
#: The longest byline, and elements that may be one comment of several.
BYLINE, REPEATED = 60, frozenset("li div section article".split())
#: Names that begin so deny, or only mention, what follows.
MENTIONS = frozenset("no not has with without hide hidden show is".split())
#: Telling class names, ids and roles (a parameter): English, German, French, Spanish.
WORDS = {
    2.0: "article artikel articulo",
    1.5: "content contenu inhalt contenido story main hauptinhalt beitrag",
    1.0: "post entry",
    0.5: "body text texte texto",
    -5.0: "header entete cabecera kopfzeile",
    -6.0: "masthead widget related verwandt relacionado recommended empfohlen share teilen partager compartir social search suche recherche buscar "
    "pagination copyright toolbar alert",
    -7.0: "promo banner nav navigation navegacion menu menue menü breadcrumb breadcrumbs brotkrumen footer fusszeile fußzeile pied pie notice "
    "hinweis hinweise avis aviso popup modal newsletter subscribe abonnieren signup login anmelden contentinfo complementary disclaimer",
    -8.0: "sponsor sponsored sidebar seitenleiste seitenspalte barre lateral cookie cookies consent zustimmung reply antworten",
    -9.0: "ad ads advert advertisement adverts anzeige anzeigen werbung publicite publicité pub publicidad anuncio anuncios comment comments kommentar "
    "kommentare commentaire commentaires comentario comentarios disqus",
}
TELLING = {w: odds for odds, words in WORDS.items() for w in words.split()}

#: Features of a block's own text, and the prior of their weights.
FEATURES = ("bias", "linked", "length", "sentence", "digits", "paragraph", "heading", "item", "other", "names")
PRIOR = (-0.5, -4.0, 0.4, 0.5, 0.0, 0.5, 0.5, 0.0, 0.0, 1.0)
#: Pages whose blocks are the labelled rows of fit(), at most.
SAMPLE = 1000
SMOOTH = 1.0
#: Capacities are multiples of 1 / UNIT, so the flow is exact; odds are multiples of 1 / GRAIN, so a flow does not trickle through thousands of blocks.
UNIT = 1 << 32
GRAIN = 64
_KINDS = {"p": 5, "h1": 6, "h2": 6, "h3": 6, "h4": 6, "li": 7, "dt": 7, "dd": 7, "td": 7, "th": 7}


def _odds_of_names(attributes: str, telling: dict) -> float:
    """The mean over an element's class names, ids and roles; a name of several parts counts by its strongest."""
    total, n = 0.0, 0
    for found in _ATTR.findall(attributes):
        for name in "".join(found).split():
            parts = _WORD.findall(_HUMP.sub(" ", name).lower())
            mentioned = len(parts) > 1 and parts[0] in MENTIONS
            total += 0.0 if mentioned else max((telling.get(p, 0.0) for p in parts), key=abs, default=0.0)
            n += 1
    return total / n if n else 0.0


class Block:
    """A block of text: what it holds, where it stands, and the odds that its surroundings give it."""

    __slots__ = ("parts", "linked", "text", "kind", "parent", "depth", "low", "around", "names", "sure")

    def __init__(self, kind, parent, depth, low, sure):
        self.parts, self.linked, self.text, self.around, self.names = [], 0, "", 0.0, 0.0
        self.kind, self.parent, self.depth, self.low, self.sure = kind, parent, depth, low, sure


class Mark:
    """An element that speaks for or against the blocks begin to end - 1."""

    __slots__ = ("what", "odds", "number", "begin", "end")

    def __init__(self, what, odds, number, begin):
        self.what, self.odds, self.number, self.begin, self.end = what, odds, number, begin, None


def _weigh(out: list[Block], marks: list[Mark], siblings: dict, anchors: dict[str, tuple[int, int]]) -> None:
    """Fill in what surrounds each block: the odds of elements, and of names, above it."""
    size = [0]
    for b in out:
        size.append(size[-1] + len(b.text))
    anchor = next((anchors[k] for k in ("main", "article", "h1") if k in anchors), None)
    elements, names = [0] * (len(out) + 1), [0] * (len(out) + 1)

    def add(to, begin, end, odds):
        to[begin] += round(odds * UNIT)
        to[end] -= round(odds * UNIT)

    for m in marks:
        end = len(out) if m.end is None else m.end
        holds = anchor is not None and m.number < anchor[0] and m.begin <= anchor[1] < end
        wraps = 2 * (size[end] - size[m.begin]) > size[-1] and (holds or anchor is None and m.what == "form")
        if m.odds > 0 or m.what == "element" or not wraps:
            add(names if m.what == "name" else elements, m.begin, end, m.odds)
    for spans in siblings.values():
        told = [out[a].kind != 6 and len(out[a].text) <= BYLINE for a, _ in spans]
        if len(spans) > 1 and 5 * sum(told) >= 4 * len(spans) and not any(anchor is not None and a <= anchor[1] < z for a, z in spans):
            for a, z in spans:
                add(elements, a, z, BYLINES)
    e = k = 0
    for i, b in enumerate(out):
        e, k = e + elements[i], k + names[i]
        b.around, b.names = e / UNIT, k / UNIT


def blocks_of(html: str, telling: dict = TELLING) -> list[Block]:
    """The text blocks of a page in order; one forward scan, whatever the markup."""
    stack: list[tuple] = []  # (name, number, marks, class) of the open block-level elements
    places: dict[str, list[int]] = {}  # where elements of a name stand in the stack
    scopes: list[int] = []
    above = Counter()  # open elements by name
    marks: list[Mark] = []
    siblings: dict[tuple, list[tuple[int, int]]] = {}  # blocks of the elements of one kind and parent
    anchors: dict[str, tuple[int, int]] = {}  # number and first block of the page's first main, article and h1
    inline_links = hidden = foreign = number = at = site = 0  # site: open elements that are the page's, not the text's
    low = 0  # least depth since the last block began
    out: list[Block] = []
    current, raw, n = None, None, len(html)
    missing = set()  # quotes that do not come again

    def text(s: str):
        nonlocal current, low
        if hidden == 1 and above["head"] and s.strip():
            close("head")
        if hidden or not s:
            return
        if current is None:
            if s.isspace():
                return
            kind = _KINDS.get(stack[-1][0], 8) if stack else 8
            parent = stack[-2][1] if len(stack) > 1 else -1
            sure = 0 if site else 1 if above["article"] or above["main"] else None
            current = Block(kind, parent, len(stack), min(low, len(stack)), sure)
            low = len(stack)
            out.append(current)
        s = unescape(s)
        current.parts.append(s)
        if inline_links:
            current.linked += len(s.strip())

    def open_(name: str, attributes: str):
        nonlocal number, hidden, foreign, site
        mine, odds = [], _odds_of_names(attributes, telling) if attributes and name not in ("html", "body") else 0.0
        if name == "article" and above[name] == 1:
            mine.append(Mark("element", NESTED, number, len(out)))
        elif name in ELEMENTS and not above[name] and not (name == "header" and (above["article"] or above["main"])):
            mine.append(Mark("form" if name == "form" else "element", ELEMENTS[name], number, len(out)))
            site += ELEMENTS[name] < 0 and name != "form"
        if odds:
            mine.append(Mark("name", odds, number, len(out)))
        marks.extend(mine)
        if name in ("main", "article", "h1"):
            anchors.setdefault(name, (number, len(out)))
        above[name] += 1
        places.setdefault(name, []).append(len(stack))
        if name in SCOPES:
            scopes.append(len(stack))
        found = _CLASS.search(attributes) if name in REPEATED else None
        stack.append((name, number, mine, "".join(x or "" for x in found.groups()) if found else "", len(out)))
        number += 1
        hidden += name in HIDDEN
        foreign += name in ("svg", "math")

    def close(name: str):
        nonlocal hidden, foreign, low, site
        while stack:
            top, _, mine, kind, begin = stack.pop()
            places[top].pop()
            if top in SCOPES:
                scopes.pop()
            above[top] -= 1
            for m in mine:
                m.end = len(out)
                site -= m.what == "element" and m.odds < 0 and m.odds != NESTED
            if top in REPEATED and (kind or top in ("li", "article")) and len(out) > begin + 1:
                siblings.setdefault((stack[-1][1] if stack else -1, top, kind), []).append((begin, len(out)))
            hidden -= top in HIDDEN
            foreign -= top in ("svg", "math")
            if top == name:
                break
        low = min(low, len(stack))

    def end_of_tag(i: int) -> int:
        """Where the > of a tag is, past quoted values; -1 if there is none."""
        begin = i
        while True:
            i = _INSIDE.match(html, i).end()
            if i >= n or html[i] == ">":
                return i if i < n else -1
            quote = html[i]
            if quote in missing or not _VALUE.search(html, max(begin, i - 64), i):
                i += 1
                continue
            shut = html.find(quote, i + 1)
            if shut < 0:
                missing.add(quote)
                i += 1
            else:
                i = shut + 1

    while at < n:
        if raw:
            end = _END_OF_RAW[raw].search(html, at)
            if end is None:
                break
            at, raw = end.start(), None
        m = html.find("<", at)
        if m < 0:
            text(html[at:])
            break
        if m > at:
            text(html[at:m])
        c = html[m + 1 : m + 2]
        if c in ("!", "?") and c:
            comment = html.startswith("<!--", m)
            end = html.find("-->", m + 4) if comment else html.find(">", m)
            if end < 0:
                break
            at = end + (3 if comment else 1)
            continue
        closing = c == "/"
        name_at = _NAME.match(html, m + 1 + closing)
        if name_at is None:
            text("<")
            at = m + 1
            continue
        end = end_of_tag(name_at.end())
        if end < 0:
            break
        name, at = name_at[0].lower(), end + 1
        if closing:
            if name == "a":
                inline_links = max(0, inline_links - 1)
            if name in INLINE:
                continue
            current = None
            if above[name]:
                close(name)
            continue
        if name in INLINE:
            if name == "a":
                inline_links += 1
            elif name == "br" and current is not None and not hidden:
                current.parts.append(" ")
            continue
        current, inline_links = None, 0
        if name in VOID or foreign and html[end - 1] == "/":
            continue
        if above["head"] and hidden == 1 and name not in IN_HEAD:
            close("head")
        for shut in CLOSES.get(name, ("p",) if name in SCOPES else ()):
            here = places.get(shut)
            if here and here[-1] > (scopes[-1] if scopes else -1):
                close(shut)
        open_(name, html[name_at.end() : end])
        if name in RAW:
            raw = name
    done = []
    low = None  # of blocks that turn out empty
    for b in out:
        b.text = _SPACES.sub(" ", "".join(b.parts)).strip()
        b.parts = ()
    _weigh(out, marks, siblings, anchors)
    for b in out:
        low = b.low if low is None else min(low, b.low)
        if b.text:
            b.low, low = low, None
            done.append(b)
    return done


def features(b: Block) -> list[float]:
    """The features of a block's own text, in the order of FEATURES."""
    x = [1.0, min(1.0, b.linked / len(b.text)), min(4.0, len(b.text) / 60), float(b.text[-1] in ".!?…。:")]
    x += [sum(map(str.isdigit, b.text)) / len(b.text), 0.0, 0.0, 0.0, 0.0, b.names]
    x[b.kind] = 1.0
    return x


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges between neighbours, and between blocks of one parent that others interrupt."""
    out, last = [], {}
    for j, b in enumerate(blocks):
        if j:
            apart = blocks[j - 1].depth + b.depth - 2 * b.low
            out.append((j - 1, j, SMOOTH * 2.0 / max(1, apart)))
        i = last.get(b.parent)
        if i is not None and i < j - 1:
            out.append((i, j, SMOOTH))
        last[b.parent] = j
    return out


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether the source still reaches it: a maximum flow by two search trees that are mended, not rebuilt, after each augmentation."""
    n = len(odds)
    rest = [round(x * UNIT) for x in odds]  # left to the source if positive, to the sink if negative
    near: list[list[int]] = [[] for _ in range(n)]  # arcs that leave a node; arc ^ 1 is its reverse
    head, cap = [], []
    for i, j, c in edges:
        near[i].append(len(head))
        near[j].append(len(head) + 1)
        head += [j, i]
        cap += [round(c * UNIT)] * 2
    tree = [(x > 0) - (x < 0) for x in rest]  # 1: from the source; -1: to the sink; 0: free
    ROOT, NONE = -1, -2
    up = [ROOT if t else NONE for t in tree]  # the arc from a node to its parent
    active, waiting = deque(i for i in range(n) if tree[i]), [bool(t) for t in tree]
    stamp, clock = [0] * n, 0  # nodes known to hang from a terminal in this round

    def wake(i):
        if not waiting[i]:
            waiting[i] = True
            active.append(i)

    def rooted(i):
        path = []
        while stamp[i] != clock:
            path.append(i)
            if up[i] == ROOT:
                break
            if up[i] == NONE:
                return False
            i = head[up[i]]
        for k in path:
            stamp[k] = clock
        return True

    while active:
        p = active[0]
        side, met = tree[p], -1
        if side:
            for a in near[p]:
                if not cap[a if side > 0 else a ^ 1]:
                    continue
                q = head[a]
                if not tree[q]:
                    tree[q], up[q] = side, a ^ 1
                    wake(q)
                elif tree[q] != side:
                    met = a if side > 0 else a ^ 1
                    break
        if met < 0:
            waiting[active.popleft()] = False
            continue
        # The path: source ... tail(met) -> head(met) ... sink.
        arcs, flow = [met], cap[met]
        i = head[met ^ 1]
        while up[i] != ROOT:
            arcs.append(up[i] ^ 1)
            i = head[up[i]]
        top = i
        i = head[met]
        while up[i] != ROOT:
            arcs.append(up[i])
            i = head[up[i]]
        flow = min(rest[top], -rest[i], *(cap[a] for a in arcs))
        orphans = deque()
        rest[top] -= flow
        rest[i] += flow
        for k in {top, i}:
            if not rest[k]:
                up[k] = NONE
                orphans.append(k)
        for a in arcs:
            cap[a] -= flow
            cap[a ^ 1] += flow
            if not cap[a]:
                i, j = head[a ^ 1], head[a]
                if tree[i] == tree[j]:
                    k = j if tree[i] > 0 else i
                    if up[k] != NONE:
                        up[k] = NONE
                        orphans.append(k)
        clock += 1
        while orphans:
            k = orphans.popleft()
            side = tree[k]
            for a in near[k]:
                q = head[a]
                if tree[q] == side and cap[a ^ 1 if side > 0 else a] and rooted(q):
                    up[k] = a
                    break
            else:
                for a in near[k]:
                    q = head[a]
                    if tree[q] != side:
                        continue
                    if cap[a ^ 1 if side > 0 else a]:
                        wake(q)
                    if up[q] == a ^ 1:
                        up[q] = NONE
                        orphans.append(q)
                tree[k] = 0
    return [t > 0 for t in tree]


def main_text(html: str, weights=PRIOR, telling: dict = TELLING) -> str:
    blocks = blocks_of(html or "", telling)
    odds = [round(GRAIN * (b.around + sum(w * x for w, x in zip(weights, features(b))))) / GRAIN for b in blocks]
    return "\n".join(b.text for b, k in zip(blocks, min_cut(odds, edges_of(blocks))) if k)


def logistic(x: np.ndarray, y: np.ndarray, k: np.ndarray, prior=PRIOR, strength: float = 20.0, rounds: int = 12) -> tuple[float, ...]:
    """The likeliest weights given rows x of label y, each of weight k, and a normal prior around `prior`, by Newton steps."""
    w = np.array(prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (k * (p - y)) + strength * (w - prior)
        w = w - np.linalg.solve((x * (k * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), slope)
    return tuple(float(round(v, 6)) for v in w)


def fit(pages: DataFrame, html: str = "html", telling: dict = TELLING, sample: int = SAMPLE) -> tuple[float, ...]:
    """Weights of FEATURES from at most `sample` pages, spread over the table by a hash; the prior if they lack one of the labels.

    Both labels weigh the same in all, so a page's many blocks of one kind don't outvote the other.
    """
    share = max(1, -(-pages.count() // sample))
    x = pages.select(F.col(quoted(html)).cast("string").alias("__html"), F.xxhash64(*[F.col(quoted(c)) for c in pages.columns]).alias("__h"))
    x = x.where(F.pmod("__h", F.lit(share)) == 0).orderBy("__h").limit(sample).select("__html")
    names = [*FEATURES, "label"]

    def run(batches):
        for batch in batches:
            rows = [[*features(b), b.sure] for h in batch.column(0).to_pylist() for b in blocks_of(h or "", telling) if b.sure is not None]
            a = np.array(rows, float).reshape(-1, len(names)).round(2)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, k]) for k in range(len(names))], names=names)

    rows = x.mapInArrow(run, ", ".join(f"{c} double" for c in names)).groupBy(*names).agg(F.count("*").alias("n"))
    found = rows.toPandas().sort_values(names)  # distinct blocks of at most `sample` pages
    y, k = found["label"].to_numpy(), found["n"].to_numpy(float)
    if len(set(y)) < 2:
        return PRIOR
    k *= 100 / np.where(y > 0, k[y > 0].sum(), k[y == 0].sum())
    return logistic(found[list(FEATURES)].to_numpy(), y, k)


def extract(pages: DataFrame, html: str = "html", weights: tuple[float, ...] | None = None, telling: dict = TELLING) -> DataFrame:
    """pages without their html, with text and n_chars; without weights, fit() finds them."""
    keep = others(pages, html, "text", "n_chars")
    weights = fit(pages, html, telling) if weights is None else weights

    def run(batches):
        for batch in batches:
            texts = [main_text(x, weights, telling) for x in batch.column(len(keep)).to_pylist()]
            cols = [batch.column(k) for k in range(len(keep))]
            cols += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "text", "n_chars"])

    x = pages.select(*[F.col(quoted(c)).alias(f"__{k}") for k, c in enumerate(keep)], F.col(quoted(html)).cast("string").alias("__html"))
    new = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return x.mapInArrow(run, T.StructType([pages.schema[c] for c in keep] + new))


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
