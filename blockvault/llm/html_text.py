"""Main text of web pages by two passes over their blocks.

A page becomes a row of blocks: what stands between block-level tags.  The first pass decides blocks by the
density of stop words, their length and the share of their characters inside links, and by what encloses
them: menus, forms, adverts and the like are never main text.  The second pass gives each block that stayed
undecided (short, or of middling density) the label of its nearest decided neighbours.

Elements and roles tell for certain what encloses a block; names of classes are a hint, which counts only for as
long as a page without an article has main text outside them.  On a page whose text as a whole has hardly a stop word
that is known here, density cannot tell: sentences are taken for dense there.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Characters up to which a block is short, and from which a dense one needs no neighbours.
SHORT, LONG = 70, 200
#: Shares of stop words, and of characters inside links.
LOW, HIGH, LINKS = 0.15, 0.30, 0.5

# Frequent function words of some languages.
STOP_WORDS = frozenset(
    """the of and to a in is that it for was on are as with his they at be this from have or by had not but what all were when we there can an
    your which their if will each about how up out them then she many some so these would other into has her two him see could than been its who
    der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am
    sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man
    le la les de des du et en un une est que qui dans pour pas sur au avec ce il sont plus par ne se aux mais son ou sa cette été être ses leur nous vous elle
    el los las y que del se con no para su al lo como más pero sus este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo
    di che non per una sono del della con i gli si da come più anche ma nel o os as um uma não com mais foi ao dos das het een van dat niet op te zijn voor""".split()
)
_BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul""".split()
)
#: Elements whose text is no markup; what they hold is passed over.
_RAW = frozenset("script style title textarea noscript template iframe svg math object canvas audio video xmp noembed noframes select button".split())
_NEVER = frozenset("nav footer aside form menu dialog search datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor promo promos promotion banner sidebar sidenav menu submenu nav navbar
    navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup signin login
    share sharing sharebar social recommendations widget widgets toolbar pagination pager copyright skip hidden invisible""".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: First parts of names that say what a part of a page is, whatever follows them.
_KINDS = frozenset("related recommended sponsored promoted".split())
#: First parts of names that tell of something else, as in "has-sidebar"; last parts that tell nothing, as in "menu-left".
_OF_OTHERS = frozenset("no not has have with without is show hide js".split())
_PLACES = frozenset(
    "area bar block bottom box button buttons container group icons inner item items label left link links list outer panel right section slot text top unit wrap wrapper zone".split()
)
#: These name parts of a page, but inside an article parts of the article.
_OUTER = frozenset("header footer masthead topbar bottom legal".split())
_CONTENT = frozenset("article post entry content story".split())
_OPEN = frozenset("article main".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: What ends a sentence in most scripts: fixed values.
_SENTENCE = re.compile(r"[.!?\u061f\u06d4\u0964\u3002\uff01\uff1f\u037e\u0589]")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]).*?(?:>|\Z)", re.S | re.I) for name in _RAW}


class Block:
    __slots__ = ("parts", "linked", "never", "hint", "inside", "heading", "text", "stops", "words")

    def __init__(self, never: bool, hint: bool, inside: bool, heading: bool):
        self.parts: list[str] = []
        self.linked, self.never, self.hint, self.inside, self.heading = 0, never, hint, inside, heading


def _named(value: str, inside: bool) -> str:
    """What the names of a class or id say: "comments", "name" or nothing.  The last part of a name is what it names."""
    said = ""
    for token in value.split():
        parts = [x.lower() for x in _PART.findall(token) if len(x) > 1]
        if not parts or len(parts) > 1 and parts[0] in _OF_OTHERS:
            continue
        kind = len(parts) > 1 and parts[0] in _KINDS
        outer = not inside and _CONTENT.isdisjoint(parts)
        while len(parts) > 1 and parts[-1] in _PLACES:
            parts.pop()
        if parts[-1] in _COMMENTS:
            return "comments"
        if kind or parts[-1] in _NAMES or parts[-1] in _KINDS or outer and parts[-1] in _OUTER:
            said = "name"
    return said


def _excluded(name: str, attributes: str, inside: bool) -> str:
    """Why what the element holds is no main text: "comments", "name", another reason, or nothing."""
    if name in _NEVER or name == "header" and not inside:
        return name
    if not attributes:
        return ""
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    said = "" if name in ("body", "html") else _named(f"{found.get('class', '')} {found.get('id', '')}", inside)
    if said == "comments":
        return said
    if found.get("role", "").lower() in _ROLES and name not in ("body", "html"):
        return "role"
    style = found.get("style", "").lower().replace(" ", "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return "hidden"
    return said


def blocks(page: str) -> list[Block]:
    """The page's blocks that have text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool]] = []  # open elements that count, why their text is left out, whether they are inline
    opened: Counter[str] = Counter()  # how many of them have a name
    why: Counter[str] = Counter()  # how many of them are left out for a reason
    links = inside = dropped = 0
    block = Block(False, False, False, False)
    at = 0

    def add(text: str) -> None:
        if dropped:
            return
        if "&" in text:
            text = html.unescape(text)
        block.parts.append(text)
        if links:
            block.linked += len("".join(text.split()))

    def out_for() -> int:
        return len(stack) - why[""]

    def turn(name: str = "") -> None:
        nonlocal block
        block.text = " ".join("".join(block.parts).split())
        if block.text:
            words = _WORD.findall(block.text.lower())
            block.stops, block.words = sum(map(STOP_WORDS.__contains__, words)), len(words)
            out.append(block)
        block = Block(out_for() > why["name"], why["name"] > 0, inside > 0, len(name) == 2 and name[0] == "h" and name[1] in "123456")

    def push(name: str, reason: str, inline: bool = False) -> None:
        nonlocal inside, dropped
        stack.append((name, reason, inline))
        opened[name] += 1
        why[reason] += 1
        inside += name in _OPEN
        dropped += inline

    def pop() -> None:
        nonlocal inside, dropped
        name, reason, inline = stack.pop()
        opened[name] -= 1
        why[reason] -= 1
        inside -= name in _OPEN
        dropped -= inline

    def close(name: str) -> bool:
        if not opened[name]:
            return False
        while stack[-1][0] != name:
            pop()
        pop()
        return True

    while match := _TOKEN.search(page, at):
        if match.start() > at:
            add(page[at : match.start()])
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if match[1]:
            if name == "a":
                links = 0
            elif name in _BLOCKS:
                close(name)
                turn()
            else:  # an inline element that was left out, or nothing
                close(name)
        elif name in _RAW:
            if not match[3].endswith("/") or name in ("script", "style", "title", "textarea"):
                end = _ENDS[name].search(page, at)
                at = end.end() if end else len(page)
            if name in ("title",):
                turn()
        elif name == "br":
            block.parts.append(" ")
        elif name == "a":
            links = 1
        elif name in _BLOCKS:
            if name in _OPEN and not why["comments"]:
                while out_for():  # an article does not stand in a menu or advert, so that was not closed
                    pop()
            if stack and stack[-1][0] == "p" or stack and stack[-1][0] == name and name in ("li", "dd", "dt", "td", "th", "tr", "option"):
                pop()
            links = 0
            if name != "hr":
                push(name, _excluded(name, match[3], inside > 0))
            turn(name)
        elif match[3] and not match[3].endswith("/") and name in ("span", "b", "i", "em", "strong", "small", "font", "ins", "del", "label"):
            if reason := _excluded(name, match[3], inside > 0):
                push(name, reason, True)  # the block goes on behind it
    add(page[at:])
    turn()
    return out


def _first_pass(block: Block, known: bool) -> str:
    size = len(block.text)
    if block.never or block.linked > LINKS * len(block.text.replace(" ", "")):
        return "bad"
    dense = block.stops / max(block.words, 1)
    if not known and _SENTENCE.search(block.text):
        dense = HIGH
    if size > LONG and dense >= HIGH:
        return "good"
    if size > SHORT and not block.heading:
        if dense >= HIGH or block.inside and dense >= LOW:
            return "good"
        # Without an article around it, a longer text without function words is no prose.
        if dense < LOW and not block.inside:
            return "bad"
    return "open"


def extract(page: str | None) -> str:
    """The page's main text: its good blocks joined by line feeds."""
    found = blocks(page or "")
    able = [b for b in found if not b.never]
    known = sum(b.stops for b in able) >= LOW * sum(b.words for b in able)
    hints = [b.hint for b in found]
    # Hints do not count where they would leave a page without an article without main text.
    if any(hints) and not any(b.inside for b in found) and not any(_first_pass(b, known) == "good" for b in able if not b.hint):
        hints = [False] * len(found)
    for b, hint in zip(found, hints, strict=True):
        b.never = b.never or hint
    first = [_first_pass(b, known) for b in found]
    # An article's edges count as good neighbours inside it; blocks that are never main text are no neighbours there.
    before, last = [], {True: "good", False: "bad"}
    for b, label in zip(found, first, strict=True):
        before.append(last[b.inside])
        if label != "open" and not (b.inside and b.never):
            last[b.inside] = label
    after, last = [], {True: "good", False: "bad"}
    for b, label in zip(reversed(found), reversed(first), strict=True):
        after.append(last[b.inside])
        if label != "open" and not (b.inside and b.never):
            last[b.inside] = label
    kept = []
    for b, label, x, y in zip(found, first, before, reversed(after), strict=True):
        if label == "open":
            # Between unlike neighbours a heading goes with what follows it, other text only if it stands in an article.
            label = x if x == y else y if b.heading else "good" if b.inside else "bad"
        if label == "good":
            kept.append(b.text)
    return "\n".join(kept)


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of each row of ``df``, repeated rows included.

    A null or empty page, or one without main text, has an empty text.  Whole pages are read, nothing is cut
    off; one pass without a shuffle.  An empty table gives an empty result; other columns are not read.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["_id", "url", "text", "n_chars"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), F.col(html_col).alias("_html"))
    schema = T.StructType([rows.schema["_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
