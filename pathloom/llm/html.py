"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags by one linear scan. Pass one decides each block by its
densities: link density, length and stop-word density make it good, bad, or undecided (short, preformatted, or neither
rich nor poor in stop words). A block with much text besides its links isn't a list of links. Where hardly any word of the page is a known stop word (a language without
a list, a script without spaces), stop words say nothing and length and links decide. Pass two gives
undecided blocks the label of the nearest decided neighbours; where these differ, the nearer in characters
wins, but headings go with what follows them. Inside an article or main element, undecided blocks are good unless only bad ones of it stand near.

Some blocks take no part: those in elements that never carry main text (menus, page headers and footers,
sidebars, dialogs, scripts, styles, hidden elements, and forms unless most of the page's text is in them), and those in
elements whose class, id or role names one of these, a notice, an advert or reader comments. A name of several words does
so only if all its words say such things or where they stand (site-footer, cookie-notice); with another word in it
(related-work, share-price) it only counts against short blocks and lists of links. If no block of a page is good,
undecided blocks that aren't short count as good; if there are none, the names in class and id are given up and densities
decide alone; if that finds none either, everything that isn't ruled out and isn't mostly links stays, so a page of short
lines keeps them all.

Character references are decoded, white space in a block becomes one space. Markup needn't be well
formed: unclosed elements end with their parents, stray closing tags are ignored, a tag, comment or script
that never ends takes the rest of the page. The scan is linear in the page whatever it holds. A null or empty
page gives the empty text. Repeated rows give the same text; columns of other names pass through.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import texts

#: Frequent function words.
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui ma mais me mes mon ne nous on ou par pas pour qu que qui sa se ses son sur un une vous
    aber als am an auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so und von vor war was wie wir zu zum zur über
    al como con del el ella en era es esta este fue ha hay la las lo los más mi muy no nos o para pero por que se si sin sobre son su sus te también un una y ya""".split()
)
#: Elements whose content is text without markup, elements that never hold main text, and block-level elements.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BOILER = frozenset("aside button dialog fieldset footer head menu nav noscript object select svg template".split())
BLOCK = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li
    link main menu meta nav noscript object ol option p pre search section select summary svg table tbody td template tfoot th thead tr ul""".split()
)
HEAD = frozenset("noscript object template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Roles of elements that never hold main text.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id that name what isn't main text; a name's words stand between hyphens and underscores.
NAMED = frozenset(
    """ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer masthead menu modal nav navbar navigation
    newsletter notice popup promo related replies reply share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets""".split()
)
#: Words that say where something stands, or that it holds something; in a name they leave the others their meaning.
PLACES = frozenset("area bar block bottom box container fixed global inner item items left links list main outer page panel primary right secondary section site sticky thread top wrap wrapper".split())
#: The same as NAMED, but of the page only: an article's own header belongs to it.
NAMED_OUTSIDE = frozenset(["header"])
#: A name with one of these words says what stands beside or isn't there.
ASIDE = frozenset("has no with without".split())
#: An open element of these ends where the next of the same name starts.
REPEATED = frozenset("dd dt li option p td th tr".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LINK_DENSITY, SHORT, LONG, STOP_LOW, STOP_HIGH, KNOWN = 0.35, 40, 160, 0.12, 0.25, 0.1

_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)?")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I | re.A) for name in RAW}
_PARTS = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
_HUGE_REFERENCE = re.compile(r"&#\d{1000,};?")
_WIDE = re.compile(r"[ᄀ-ᇿ⺀-힯豈-﫿\U00020000-\U0003ffff]")


class Block(NamedTuple):
    text: str
    #: characters inside links, spaces not counted
    linked: int
    #: an element, attribute or role rules it out; a name in class or id does; a name holds a word that might
    barred: bool
    named: bool
    hinted: bool
    #: it stands in an article or main element
    article: bool
    #: it stands in a form; what kind of text it is: heading, pre, or none of these
    form: bool = False
    kind: str = ""


def tags(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, text or name, attributes) of the page's pieces: kind is text, open or close. Linear: no place is read again."""
    at, size, endless = 0, len(page), set()
    while at < size:
        start = page.find("<", at)
        if start < 0:
            break
        if start > at:
            yield "text", page[at:start], {}
        after = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
        elif after in ("!", "?"):
            end = page.find(">", start)
            at = size if end < 0 else end + 1
        elif after == "/" and (m := _NAME.match(page, start + 2)) and m[0][0].isalpha():
            end = page.find(">", m.end())
            at = size if end < 0 else end + 1
            if end >= 0:
                yield "close", m[0].lower(), {}
        elif after.isalpha():
            m = _NAME.match(page, start + 1)
            name, attributes, at = m[0].lower(), {}, m.end()
            while True:
                m = _ATTRIBUTE.match(page, at)
                at = m.end()
                if at >= size or page[at] == ">":
                    if m[1]:
                        attributes.setdefault(m[1].lower(), "")
                    at += 1
                    break
                if not m[1]:
                    at += 1  # a stray sign between attributes
                    continue
                if (eq := _EQUALS.match(page, at)) is None:
                    attributes.setdefault(m[1].lower(), "")
                    continue
                at = eq.end()
                if page[at : at + 1] in ('"', "'") and at < size:
                    end = page.find(page[at], at + 1)
                    if end < 0:
                        at = size + 1
                        break
                    value, at = page[at + 1 : end], end + 1
                else:
                    value = _BARE.match(page, at)[0]
                    at += len(value)
                attributes.setdefault(m[1].lower(), value)
            if at > size:
                return
            yield "open", name, attributes
            if name in RAW and name not in endless:
                end = _RAW_END[name].search(page, at)
                if end:
                    at = end.start()
                elif name in ("script", "style"):
                    return
                else:
                    endless.add(name)
        else:
            yield "text", "<", {}
            at = start + 1
    if at < size:
        yield "text", page[at:], {}


def decoded(text: str) -> str:
    """Character references decoded."""
    if "&" not in text:
        return text
    try:
        return entities.unescape(text)
    except ValueError:  # a number too long to be one
        return entities.unescape(_HUGE_REFERENCE.sub("�", text))


def shut(name: str, attributes: dict[str, str], article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is barred from main text by what it is, whether by the names it carries, and whether a name holds a word that might."""
    if name in BOILER or name == "header" and not article:
        return True, False, False
    if not attributes or name in ("html", "body", "article", "main"):
        return False, False, False
    style = attributes.get("style", "").replace(" ", "").lower()
    barred = "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or "display:none" in style or "visibility:hidden" in style
    barred = barred or not ROLES.isdisjoint(attributes.get("role", "").lower().split())
    hinted = False
    for said in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        words = {w.lower() for w in _PARTS.split(said) if w}
        told = {w for w in words | {said.lower()} if w in NAMED or not article and w in NAMED_OUTSIDE}
        if told and ASIDE.isdisjoint(words):
            if said.lower() in told or words <= told | PLACES:
                return barred, True, hinted
            hinted = True
    return barred, False, hinted


def blocks(page: str) -> list[Block]:
    """The page's blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool, bool]] = []  # open elements: name, barred, named, hinted, article, form
    places: dict[str, list[int]] = defaultdict(list)  # of each name, where it is in the stack
    walls: list[int] = []  # where block-level elements are in the stack
    parts: list[str] = []
    linked, link = 0, -1  # link: how many block-level elements were open where the open link started

    def close() -> None:
        nonlocal linked
        said = " ".join("".join(parts).split())
        if said:
            kind = "pre" if places["pre"] else "heading" if any(places[h] for h in HEADINGS) else ""
            out.append(Block(said, linked, *(stack[-1][1:] if stack else (False,) * 5), kind))
        parts.clear()
        linked = 0

    def cut(to: int) -> None:
        while len(stack) > to:
            name = stack.pop()[0]
            places[name].pop()
            if name in BLOCK:
                walls.pop()
        if len(walls) < link:
            end_link()

    def end_link() -> None:
        nonlocal link
        link = -1

    for kind, what, attributes in tags(page):
        if kind == "text":
            piece = decoded(what)
            parts.append(piece)
            if link >= 0:
                linked += len("".join(piece.split()))
            continue
        if what in RAW:
            continue
        block = what in BLOCK
        if kind == "close":
            if what == "a":
                end_link()
            elif what == "br":
                parts.append(" ")
            elif block:
                close()
                if places[what]:
                    cut(places[what][-1])
            elif places[what] and places[what][-1] > (walls[-1] if walls else -1):
                top = stack[places[what][-1] - 1][1:4] if places[what][-1] else (False, False, False)
                if stack[-1][1:4] != top:
                    close()
                cut(places[what][-1])
            continue
        if what == "a":
            link = len(walls)
            continue
        if what in VOID and what != "hr":
            if what == "br":
                parts.append(" ")
            elif block:
                close()
            continue
        if block:
            close()
            if what == "hr":
                continue
            last = stack[walls[-1]][0] if walls else ""
            if last == "p" or last == what in REPEATED or last == "head" and what not in HEAD:
                cut(walls[-1])
        barred, named, hinted, article, form = stack[-1][1:] if stack else (False,) * 5
        article, form = article or what in ("article", "main"), form or what == "form"
        b, n, h = shut(what, attributes, article)
        if not block and (b and not barred or n and not named or h and not hinted):
            close()
        places[what].append(len(stack))
        if block:
            walls.append(len(stack))
        stack.append((what, barred or b, named or n, hinted or h, article, form))
    close()
    # A form is no main text unless most of the page's own words are in it.
    own = lambda inside: sum(len(b.text) - b.linked for b in out if b.form == inside and not (b.barred or b.named))
    if own(True) > own(False):
        return out
    return [b._replace(barred=True) if b.form else b for b in out]


def length(text: str) -> int:
    """Characters; one of a script without spaces says as much as three letters."""
    return len(text) if text.isascii() else len(text) + 2 * len(_WIDE.findall(text))


def link_heavy(b: Block) -> bool:
    """Mostly links, with little text of its own beside them."""
    size = len(b.text.replace(" ", ""))
    return b.linked > LINK_DENSITY * max(1, size) and size - b.linked < LONG


def stop_words(text: str) -> tuple[int, int]:
    """Words and stop words of a text."""
    words = text.lower().split()
    return len(words), sum(w in STOP_WORDS or w.strip(".,;:!?()\"'*#%&$") in STOP_WORDS for w in words)


def judged(found: list[Block], by_name: bool) -> list[int]:
    """Pass one: 1 good, -1 bad, 0 undecided."""
    out, counts = [], [(0, 0)] * len(found)
    for i, b in enumerate(found):
        if not (b.barred or by_name and b.named or link_heavy(b)) and length(b.text) >= SHORT:
            counts[i] = stop_words(b.text)
    known = sum(s for _, s in counts) >= KNOWN * sum(n for n, _ in counts)
    for b, (words, stops) in zip(found, counts, strict=True):
        size, share = length(b.text), stops / words if words else 0.0
        if b.barred or by_name and (b.named or b.hinted and size < SHORT) or link_heavy(b):
            out.append(-1)
        elif b.kind == "pre":
            out.append(0)
        elif size < SHORT:
            out.append(-1 if b.text.startswith(("©", "(c) ")) and not b.article else 0)
        elif not known:
            out.append(1 if size >= LONG // 2 else 0)
        elif size >= LONG and share >= STOP_HIGH or b.article and share >= STOP_LOW:
            out.append(1)
        else:
            out.append(0 if b.article or share >= STOP_LOW else -1)
    return out


def settled(found: list[Block], labels: list[int], by_name: bool = True) -> list[int]:
    """Pass two: undecided blocks take the label of their nearest decided neighbours, where these differ the nearer one's.

    In an article, neighbours are the article's own blocks: what is ruled out between them (a form, comments) says
    nothing about them, a good block on either side is enough, and blocks with no decided neighbour are good.
    """
    n = len(found)

    def nearest(order) -> list[tuple[int, int, int]]:
        """Label and distance of the last decided block before each in this order, and the last decided one of an article."""
        out, seen, far, inside = [(0, 0, 0)] * n, 0, 0, 0
        for i in order:
            out[i] = seen, far, inside
            size, label = len(found[i].text), labels[i]
            seen, far = (label, 0) if label else (seen, far + size)
            if not found[i].article:
                inside = 0
            elif label and not (found[i].barred or by_name and found[i].named):
                inside = label
        return out

    out = list(labels)
    for i, (left, right) in enumerate(zip(nearest(range(n)), nearest(range(n - 1, -1, -1)), strict=True)):
        if labels[i]:
            continue
        if found[i].article:
            out[i] = 1 if max(left[2], right[2]) > 0 or left[2] == right[2] == 0 else -1
        elif found[i].kind == "heading" and right[0]:
            out[i] = right[0]
        elif not right[0] or left[0] and left[1] <= right[1]:
            out[i] = left[0]
        else:
            out[i] = right[0]
    return out


def labelled(found: list[Block]) -> list[int]:
    """The labels of both passes, with what stands in for them on pages without a good block."""
    first = judged(found, True)
    middling = [1 if label == 0 and length(b.text) >= SHORT else label for b, label in zip(found, first, strict=True)]
    for labels, by_name in ((first, True), (middling, True), (None, False)):
        out = settled(found, judged(found, False) if labels is None else labels, by_name)
        if max(out, default=0) > 0:
            return out
    # Short lines, or little beside links: what isn't ruled out stays as a whole.
    for left in ([b for b in found if not (b.barred or b.named or b.hinted or link_heavy(b))], [b for b in found if not b.barred and not link_heavy(b)], [b for b in found if not b.barred and len(b.text.replace(" ", "")) - b.linked >= SHORT // 2]):
        if left:
            stays = {id(b) for b in left}
            return [1 if id(b) in stays else -1 for b in found]
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, label in zip(found, labelled(found), strict=True) if label > 0)


@F.arrow_udf(T.StringType())
def _main_texts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        yield pa.array([main_text(p) for p in texts(column)], pa.string())


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text, the main text; a column of this name is replaced."""
    return pages.withColumn("text", _main_texts(F.col(f"`{html_col}`")))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
