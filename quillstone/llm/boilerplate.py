"""The main text of web pages that came as lines, by tree scoring.

The tree is page, section (lines without a blank one between), run (neighbouring lines of a section that look alike) and
line. A line has a link density between 0 and 1, from its shape (no sentence, items between marks, few words,
pointing marks), from how often its site repeats it, from how it addresses the reader, and from the lines beside it; common
words of menus and prompts are one weak sign among these. A line has points for its length and commas, less its link
density. It passes their mean to its run, half of that to its section and half of that to the page; a lone title is also
passed half the points of the container that it heads. The run with most points is the main container; of its siblings
those with at least ``LOW`` of its points are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Collection
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.lines import leaf_of, parsed, repeated_templates, with_templates
from quillstone.staging import stage

#: The share of the main container's points that a sibling needs, and the bounds of what that may come to.
LOW, LEAST, MOST = 0.1, 0.45, 0.6
#: Points that a title gets at least from a container that it heads, and the link density up to which the main container stays whatever it scores.
HEADED, LISTED = 2.0, 0.65

# Words that menus, prompts and notices of all sites share (a star: any ending), ways in which a page speaks of itself and to its reader, and words of reissues.
_CHROME = """cookie* consent preferences privacy imprint sitemap site_map legal_notice terms_of_use terms_and_conditions terms_apply accessibility disclaimer rights_reserved copyright reproduced
subscri* newsletter* sign_up signed_up sign_in signed_in log_in login log_out logout register download mobile_app alert alerts follow share_this share_on share_via tweet email_this email_a e-mail_this e-mail_a
print_this print_page send_to tell_a copy_link save_for post_this browser device opt_out inbox reuse delayed responsibility information_only version comment comments menu home search contact about_us careers help
faq faqs newsroom publications press_room archive latest popular trending recommended related most_read read_more read_also read_next see_also also more_on more_from more_stories more_news editor's editors favourites
picks advertis* sponsored back_to_top skip_to next previous watch reporting editing edited newsdesk desk staff hub tools utc gmt"""
_SELF = "this_site this_website this_web_site our_site our_sites our_website the_site the_website this_page this_pages our_page our_pages the_page the_pages this_service our_service the_service our_partners this_item this_article this_story the_article linked_pages queries"
_READER = "you your us we our"
_NOTE = "correction corrected corrects reissue reissued re-issued refiled re-filed amendment paper_copy supersed* replaces amended restate*"
_SIGN_WORDS: list = []


def _sign_words():
    """An automaton, for lowercased text, of those words with their kind: 0 of menus, 1 of the page itself, 2 of the reader, 3 of reissues."""
    if not _SIGN_WORDS:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, words in enumerate((_CHROME, _SELF, _READER, _NOTE)):
            for w in words.split():
                w = w.replace("_", " ")
                a.add_word(w.rstrip("*"), (kind, len(w.rstrip("*")), w[-1] == "*", w))
        a.make_automaton()
        _SIGN_WORDS.append(a)
    return _SIGN_WORDS[0]


def _words_of(low: str) -> tuple[set[str], ...]:
    """The different words of each kind that ``low`` holds as whole words."""
    found: tuple[set[str], ...] = (set(), set(), set(), set())
    end = len(low) - 1
    for last, (kind, size, open_, word) in _sign_words().iter(low):
        first = last - size
        if (first < 0 or not low[first].isalnum()) and (open_ or last == end or not low[last + 1].isalnum()):
            found[kind].add(word)
    return found


_IMPERATIVE = re.compile(r"^(?:get|join|sign|register|download|share|follow|read|watch|see|subscribe|send|tell|email|e-mail|print|copy|save|post|accept|reject|manage|hide|change|leave|never|discover|explore|browse|find|click|visit|more)\b", re.I)
_MARKS = re.compile(r"\s*[|·›»→•]\s*|\s+[/>]\s+")
_POINTER = re.compile(r"^(?:>>|[»→›↳▶|·/])\s*\S")
_LABEL = re.compile(r"^[A-Z][\w'’]+(?: [\w'’]+)?: ?[A-Z]")
_BY = re.compile(r"^(?:\w+ )?by ")
_QUOTED = re.compile(r"[“\"«].*[”\"»]$")
_DATED = re.compile(r"\(\d{1,2} \w+(?: \d{4})?\)$")
_CLOCK = re.compile(r"\b\d{1,2}[:.]\d{2}\b")
_BULLET = re.compile(r"^(?:[*•▪‣–-]|\d{1,2}[.)])\s")
_TABLE = re.compile(r"\t.*\d|\(\d+(?:[.,]\d+)?\)$|(?:\|\s*\d[\d.,]*\s*\|)|(?:\|\s*[(\d][\d.,()%\s-]*)+$")
_BREAK = re.compile(r"[.!?] [A-ZÀ-Þ]\w*(?: \w+)*$")
_NAMES = re.compile(r"\b[A-ZÀ-Þ][\w'’-]+ [A-ZÀ-Þ][\w'’-]+")
_ENDS = ".!?:;…"


@lru_cache(maxsize=200_000)
def _signs(raw: str) -> tuple[float, float, bool]:
    """What speaks for a link and against own text (log odds), points before the discount, and whether the line is a title."""
    s = " ".join(raw.split())
    size, words = len(s), s.count(" ") + 1
    points = 1 + s.count(",") + min(size / 100, 3)
    tail = s.rstrip("\"'”’»)")[-1:]
    sentence = (tail in _ENDS or s[-1] in _ENDS) and words >= 4
    items = [x for x in _MARKS.split(s) if x]
    marked = len(items) > 1 and sum(len(x) for x in items) / len(items) < 32
    if words == 1 and size > 40 and not marked:
        return -2.0, points, False  # an encoded stretch
    if ("\t" in raw or s[-1] == ")" or "|" in s) and _TABLE.search(raw.strip()) and not _DATED.search(s):
        return -3.0, points, False
    if _BULLET.match(s) and "©" not in s and not (marked and len(items) > 2):
        return -2.5, points, False
    low = s.lower()
    chrome, itself, reader, note = map(len, _words_of(low))
    broken = bool(_BREAK.search(s))
    title = not sentence and not broken and s[-1] not in ",;" and not s[0].islower() and words >= 3
    e = 0.0
    prose = sentence or words > 8 and not marked and chrome < 4
    if sentence:
        e -= 1.6 + 0.1 * min(words - 4, 16)
    elif s[0].islower() and words > 3 or s[-1] == "," or prose and (broken or "," in s or words > 11) or sum(c.isdigit() for c in s) > size / 4:
        e -= 1.2  # part of a wrapped sentence
    else:
        e += 0.2 + (1.0 if words <= 3 else 0.5 if words == 4 else 0.0)
    if marked:
        e += 1.2 * min(len(items) - 1, 3)
    if chrome:
        e += (0.45 * min(chrome, 3) + 1.6 * (reader > 0)) if prose else 1.5 + 0.8 * min(chrome - 1, 3)
    e += 1.4 * min(itself, 2) + (0.5 + 0.8 * (itself > 0)) * (reader > 0) + 0.7 * max(0, reader - 1) + 1.2 * (reader > 0 and s[-1] == "?")
    if _IMPERATIVE.match(s):
        e += 0.9
    if _POINTER.match(s):
        e, title = e + 3.0, False
    if "©" in s or low.startswith("(c)"):
        e += 4.0
    if not sentence and (_LABEL.match(s) or _DATED.search(s)):
        e += 1.2
    if not sentence and _QUOTED.search(s) and s[0].isdigit():
        e += 1.5
    if _CLOCK.search(s) and words < 14:
        e += 1.0
    if _BY.match(low) and not sentence and words < 10:
        e += 1.5
    if note:
        e -= 1.8
    if title:
        points = 1 + min(size / 100, 3)
    return e, points, title


def _sigmoid(e: float) -> float:
    return 1 / (1 + math.exp(-e)) if e > -30 else 0.0


def own_lines(text: str, repeated: Collection[int] = ()) -> list[bool]:
    """For each line of ``text`` split at \\n, whether it is part of the page's headline or own text; blank lines are.

    ``repeated``: leaves (see ``lines``) of the lines that the page's site repeats.
    """
    raw = text.split("\n")
    keep = [True] * len(raw)
    signs = [_signs(x) if x and not x.isspace() else None for x in raw]
    again = [bool(repeated) and s is not None and leaf_of(x) in repeated for x, s in zip(raw, signs)]
    runs = _runs(signs, again, raw)
    if not runs:
        return keep
    for run in runs:
        run.score(signs)
    sections: dict[int, float] = {}
    for run in runs:
        sections[run.section] = sections.get(run.section, 0.0) + run.points / 2
    page = sum(sections.values()) / 2
    main = max(runs, key=lambda run: run.points * len(run.lines))
    best = max(run.points for run in runs)
    needed = min(max(LOW * best, LEAST), MOST)
    below, follow = None, 0.0
    for run in reversed(runs):
        points = run.points
        if run.headline:
            points += (1 - run.lexical) ** 2 * best
        elif run.title and below is not None and (below is run.next or run.lone):
            points += (1 - run.lexical) ** 2 * max(follow, HEADED)  # it heads that container
        elif run.density < 0.5:
            points += 0.01 * page
        if points < needed and not (run is main and run.density < LISTED):
            for i in run.lines:
                keep[i] = False
        elif run.density < 0.5:
            below, follow = run, max(run.points, 0.9 * follow)
        elif run.title and below is not None:
            below = run
    return keep


class _Run:
    def __init__(self, section: int):
        self.section = section
        self.next: _Run | None = None
        self.lines: list[int] = []
        self.odds: list[float] = []
        self.points = self.density = self.lexical = 0.0
        self.title = self.lone = self.headline = False
        self.raw_odds = -9.0

    def score(self, signs: list) -> None:
        """Points and density of the container: those of its lines, by their number."""
        d = [_sigmoid(e) for e in self.odds]
        p = [signs[i][1] for i in self.lines]
        self.density = sum(d) / len(d)
        self.points = (1 - self.density) * sum(x * (1 - y) for x, y in zip(p, d)) / len(p)
        self.lexical = _sigmoid(self.raw_odds)
        self.title = len(self.lines) < 3 and all(signs[i][2] for i in self.lines)


def _site_names(signs: list, raw: list[str]) -> set[str]:
    """Pairs of capitalised words that two or more of the page's likely links hold: the site's name for itself."""
    seen: dict[str, int] = {}
    for s, x in zip(signs, raw):
        if s is not None and s[0] > 0.8:
            for pair in {m.lower() for m in _NAMES.findall(" ".join(x.split()))}:
                seen[pair] = seen.get(pair, 0) + 1
    return {pair for pair, n in seen.items() if n > 1}


def _runs(signs: list, again: list[bool], raw: list[str]) -> list[_Run]:
    runs: list[_Run] = []
    blank = [True, *(s is None for s in signs), True]
    neutral = [s is not None and s[2] and -1 < s[0] < (1.3 if blank[n] and (blank[n + 2] or signs[n + 1][0] < -1) else 0.6) for n, s in enumerate(signs)]
    first = next((n for n, x in enumerate(neutral) if x and not (n and neutral[n - 1]) and not (n + 1 < len(signs) and neutral[n + 1])), -1)
    names = _site_names(signs, raw)
    named = re.compile("|".join(re.escape(x).replace(r"\ ", r"\s+") for x in sorted(names)), re.I) if names else None
    i, section = 0, 0
    while i < len(signs):
        if signs[i] is None:
            i += 1
            continue
        j = i
        while j < len(signs) and signs[j] is not None:
            j += 1
        odds = [signs[n][0] + (2.2 if again[n] else 0.0) + (1.8 if named and not (neutral[n] and len(raw[n].split()) > 4 and "," not in raw[n]) and named.search(raw[n]) else 0.0) for n in range(i, j)]
        for n in range(1, j - i):  # a sentence that goes on in the next line
            head, rest = raw[i + n - 1].rstrip(), raw[i + n].lstrip()
            if len(head) > 50 and head[-1] not in _ENDS and (rest[0].islower() or rest[0].isdigit()) and not signs[i + n][2] and odds[n - 1] < 1.5:
                odds[n - 1] -= 1.5
                odds[n] -= 1.5
            if signs[i + n][0] == -3.0 and raw[i + n].count("|") == raw[i + n - 1].count("|") > 0:
                odds[n - 1] = -2.0  # the header of a table
        near = [max(-1.0, min(2.0, e)) for e in odds]
        smooth = [e + (0.6 if e > -1 else 0.2) * (sum(near[max(0, n - 1) : n + 2]) - near[n]) if abs(e) < 2 else e for n, e in enumerate(odds)]
        last = j - i - 1
        for n in (0, last):  # a lone title at an end of its section may head what follows
            if last and neutral[i + n] and not neutral[i + (1 if n == 0 else last - 1)]:
                smooth[n] = odds[n] = min(odds[n], 0.2)
        if i <= first < j:
            smooth[first - i] = odds[first - i]
        for n, e in enumerate(smooth):
            alone = i + n == first or n in (0, last) and e == odds[n] and neutral[i + n]
            if not n or (e < 0) != (smooth[n - 1] < 0) or alone or runs[-1].lone:
                runs.append(_Run(section))
                if len(runs) > 1:
                    runs[-2].next = runs[-1]
                runs[-1].lone, runs[-1].headline = alone, i + n == first
            runs[-1].lines.append(i + n)
            runs[-1].odds.append(e)
            runs[-1].raw_odds = max(runs[-1].raw_odds, odds[n])
        section += 1
        i = j
    return runs


def marked_lines(pages: DataFrame) -> DataFrame:
    """``pages`` (id, source, text) with ``own``: for each line of the text whether it is the page's own.

    ``source`` is the site whose repeated lines count against them (see ``lines``); null is a site of its own, and without the column all pages are one site's.
    """
    site = F.col("source") if "source" in pages.columns else F.lit(None).cast("string")
    pages = pages.select("id", site.alias("source"), "text")
    found = stage(repeated_templates(stage(parsed(pages)).frame).select("source", "leaf")).frame
    marked = with_templates(pages, found, own_lines, "array<boolean>")
    return marked.select("id", "source", "text", F.coalesce("done", F.array(F.lit(True))).alias("own"))


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """(id, line_no) of every non-blank line of ``pages`` (id, source, text) that is not headline or own text; null texts have none."""
    return marked_lines(pages).select("id", F.posexplode("own").alias("at", "own")).where("not own").select("id", (F.col("at") + 1).alias("line_no"))


def main_text(pages: DataFrame) -> DataFrame:
    """(id, text, removed): every page without those lines; null stays null, a page all of boilerplate becomes blank."""
    kept = F.filter(F.arrays_zip(F.split("text", "\n", -1).alias("line"), F.col("own").alias("own")), lambda x: x["own"])
    return marked_lines(pages).select("id", F.when(F.col("text").isNotNull(), F.array_join(kept["line"], "\n")).alias("text"), F.size(F.filter("own", lambda x: ~x)).alias("removed"))
