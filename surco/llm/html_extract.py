"""Main text of HTML pages by the maximum-scoring subsequence of words and tags.

A page is read as a row of tags and words. Words score positive, tags negative,
by weights from pages that label their own content (an `article` or `main`
element). One linear scan finds the contiguous region of the largest sum; the
text blocks that it touches, less the parts that are never content (menus,
forms, adverts, comments of readers and the like), are the main text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import in_parts

# Elements that begin a new block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split())
# Elements whose content is never page text, and those without content.
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that are no part of an article.
ASIDE = frozenset("nav footer aside form menu dialog button select svg math canvas object template audio video datalist head".split())
# Elements that hold the page or its content, whatever their class, id or role says of it.
WHOLE = frozenset("html body main article".split())
# Words in class, id or role that mark such parts; the second row only where no word of the third is beside them.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr "
    "sidebar nav navbar navigation menu breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond share "
    "sharing social related recommended newsletter subscribe subscription popup modal overlay footer pagination pager contentinfo "
    "complementary dialog".split())
WEAK_MARKS = frozenset("header masthead banner notice notices alert search widget toolbar login signup legal copyright disclaimer hidden".split())
CONTENT = frozenset("article content main post entry story body text".split())

TOKEN = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)|<[!?](?:[^>]*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))")
LABEL = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
UNSEEN = re.compile(r"\bhidden(?=[\s/>=])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
SPLIT = re.compile(r"[^a-z]+")

# Scores where no labelled page says otherwise.
DEFAULT = {"word": 1.0, "tag": -1.0, "part": -4.0}


def is_aside(name: str, rest: str, in_content: bool) -> bool:
    if name in ASIDE or name == "header" and not in_content:
        return True
    if "=" not in rest and "hidden" not in rest:
        return False
    if UNSEEN.search(rest):
        return True
    if name in WHOLE:
        return False
    for m in LABEL.finditer(rest):
        words = set(SPLIT.split((m[1] or m[2] or m[3] or "").lower()))
        if words & MARKS or words & WEAK_MARKS and not words & CONTENT:
            return True
    return False


def events(page: str) -> list[tuple[str, int, str, bool]]:
    """(feature, number of block, text, inside a labelled content element) in page order.

    Features: `word:<block element>`, `tag:<element>`, `part:<element>` for a skipped part.
    """
    out: list[tuple[str, int, str, bool]] = []
    at, block, holder, content = 0, 0, "body", 0
    skipping, depth, inner = "", 0, 0
    raw_end: re.Pattern | None = None
    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        start = m.start() if m else size
        if start > at and not skipping:
            out.append((f"word:{holder}", block, page[at:start], content > 0))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW and not closing:
            raw_end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+>?", re.I)
            end = raw_end.search(page, at)
            at = end.end() if end else size
            continue
        if skipping:
            # A part ends with its own element, or with what closes it unsaid.
            if name == skipping and name not in ("p", "li"):
                depth += -1 if closing else 1
            elif skipping != "p" and name in ("article", "main") and (inner or not closing):
                inner += -1 if closing else 1  # within the part
            elif name == skipping or closing and name in ("article", "main", "body") or skipping == "p" and name in BLOCKS:
                depth = 0
            elif skipping == "li" and closing and name in ("ul", "ol", "menu"):
                depth = 0
            if depth > 0 or closing and name == skipping:
                if depth <= 0:
                    skipping = ""
                continue
            skipping = ""
        if not closing and name not in VOID and not m[3].endswith("/>") and is_aside(name, m[3], content > 0):
            skipping, depth, inner = name, 1, 0
            block += name in BLOCKS
            out.append((f"part:{name}", block, "", content > 0))
            continue
        if name in ("article", "main"):
            content = max(0, content + (-1 if closing else 1))
        if name in BLOCKS:
            block += 1
            holder = "body" if closing else name
        elif name == "br":
            out.append(("tag:br", block, " ", content > 0))
            continue
        out.append((f"tag:{'/' if closing else ''}{name}", block, "", content > 0))
    return out


def fit_weights(pages: Iterable[str | None], least: float = 0.02, most: float = 6.0) -> dict[str, float]:
    """Log odds of each feature in labelled content against outside it; words stay positive where content has them, tags negative."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page in pages:
        for feature, _, text, content in events(page or ""):
            n = len(text.split()) if feature.startswith("word:") else 1
            (inside if content else outside)[feature] += n
    if not inside:
        return {}
    n_in, n_out = inside.total() + 1, outside.total() + 1
    out = {}
    for f in inside | outside:
        odds = math.log((inside[f] + 0.5) / n_in) - math.log((outside[f] + 0.5) / n_out)
        word = f.startswith("word:") and inside[f] > 0
        out[f] = min(most, max(least, odds)) if word else -min(most, max(least, -odds if odds < 0 else least))
    return out


def best_region(scores: Iterable[float]) -> tuple[float, int, int]:
    """The greatest sum of neighbouring scores, and the first and last of them; (0, 0, -1) where no sum is above 0."""
    best, best_from, best_to, total, begin = 0.0, 0, -1, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, best_from, best_to = total, begin, i
    return best, best_from, best_to


def scored(row: list[tuple[str, int, str, bool]], weights: dict[str, float]) -> Iterable[float]:
    """Words score by their number, tags and skipped parts once."""
    for feature, _, text, _ in row:
        kind = feature.partition(":")[0]
        yield weights.get(feature, DEFAULT[kind]) * (len(text.split()) if kind == "word" else 1)


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best region, in page order, joined by an empty line; "" where nothing scores above 0."""
    if not page:
        return ""
    row = events(page)
    _, first, last = best_region(scored(row, weights))
    if last < 0:
        return ""
    low, high = row[first][1], row[last][1]
    blocks: dict[int, list[str]] = {}
    for _, block, text, _ in row:
        if text and low <= block <= high:
            blocks.setdefault(block, []).append(text)
    cleaned = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(x for x in cleaned if x)


def labelled_weights(df: DataFrame, key: str, page: str, sample: int) -> dict[str, float]:
    """Weights from at most `sample` pages that label their content, the first by hash of their key."""
    labelled = df.filter(F.lower(F.col(page)).rlike("<(article|main)[\\s>]"))
    chosen = labelled.select(F.xxhash64(key).alias("h"), F.col(page).alias("page")).orderBy("h", "page").limit(sample)
    return fit_weights(r["page"] for r in chosen.toLocalIterator())


def extract(
    df: DataFrame, key: str = "page_id", page: str = "html", url: str = "url", sample: int = 400, weights: dict[str, float] | None = None,
) -> DataFrame:
    """Key, url, text and n_chars (code points) of every row of `df`.

    A null or empty page, and one without content, gives "". Repeated rows stay.
    `weights` come from `labelled_weights` over at most `sample` pages if not given;
    without labelled pages every word scores 1 and every tag -1.
    """
    if weights is None:
        weights = labelled_weights(df, key, page, sample)
    schema = df.select(key, url).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in in_parts(batches, 2):
            texts = [main_text(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[key, url, "text", "n_chars"])

    return df.select(key, url, page).mapInArrow(run, schema)
