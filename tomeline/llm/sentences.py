"""Sentence boundaries across languages and scripts, by document-centred disambiguation.

A stop is ambiguous after an abbreviation, an initial or a number. Whether the token before it is an abbreviation and
whether the word after it is a proper name is settled by unambiguous occurrences elsewhere: a token whose stop is
followed by small letters or numbers is an abbreviation, a word seen in small letters is no proper name. The document
itself counts first, the corpus where the document is silent. Chinese, Japanese, Thai, Arabic and Hindi have their own
terminators; a line break is a boundary unless the line was wrapped.

Undefined cases: a null or blank text has no sentence; texts are read whole; a repeated doc_id gives each sentence
once; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.session import cut

# Abbreviations that stand before what they belong to, and so end no sentence.
LEADING = frozenset(
    "mr mrs ms mx dr prof st mt gen col sgt capt lt rev hon sen rep gov pres no nos nr fig figs vol vols ch chap sec art pp p pg ed eds cf vs e.g i.e approx ca incl al resp viz abb bd hr fr frau s z.b d.h u.a.m bzw vgl evtl ggf z d p.ex ex m mm mme mlle env av núm pág sr sra srta dra ud uds ej q h tr ts ths pgs gs bs ks tp стр рис г ул д-р им см т.е डॉ श्री प्रो ดร นาย พ.ศ ค.ศ د أ ص م ม.ร.ว ph.d dept est inc.. ee jan feb mar apr jun jul aug sept sep oct nov dec eq".split()
) | {"v"}
# Abbreviations that may also be the last word of a sentence.
CLOSING = frozenset("etc v.v ltd co inc corp jr sr. a.m p.m am pm u.s u.k usa ee.uu uu u.a a usw u.s.w т.д т.п д др т al mon tue wed thu fri sat sun t h kg lb in ft oz d.c b.c ad น ฯลฯ р руб тыс".split())
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
OPENERS = {"“": "”", "„": "“", "«": "»", "(": ")", "[": "]", "‘": "’", "「": "」", "『": "』", "（": "）", "《": "》", "【": "】"}
CLOSE = "”’»)]」』）》】\"'"
MARKER = regex.compile(r"\s*(?:#{1,6}\s+)?(?:(?:[-*•·–▪◦]|\p{N}{1,3}[.)]|\p{L}[.)])\s+)*")
LIST = regex.compile(r"\s*(?:[-*•·–▪◦]|\p{N}{1,3}[.)]|\p{Ll}[.)])\s+\S")
STOPS = regex.compile(r"[.!?…؟۔。！？｡]+|[।॥]+[!?]*")
NOTE = regex.compile(r"(?:\[\p{N}{1,3}\]|[¹²³⁰⁴-⁹]+|\*{1,2}(?=\s|$)|[†‡])+")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
THAI = regex.compile(r"\p{Thai}")
UNSPACED = regex.compile(r"[\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}]")
BLOCK, LINE, SPACES = regex.compile(r"(?:[^\r\n]+(?:\r\n|\r|\n)?)+"), regex.compile(r"[^\r\n]+"), regex.compile(r"\s+")
CHUNK, LAST_CHUNK, NUMBER_CHUNK, NUMBER_THAI = regex.compile(r"\S+"), regex.compile(r"\S+$"), regex.compile(r"\p{N}\s+\S+$"), regex.compile(r"\p{N}+\s+\p{Thai}{8,}")
STUCK, ADDRESS, DOTTED = regex.compile(r"[\p{L}\p{M}\p{N}%”»)]+$"), regex.compile(r"www|http|@"), regex.compile(r"(?:\p{L}\.)+\p{L}")
SMALL, CAPITAL = regex.compile(r"\p{Ll}"), regex.compile(r"\p{Lu}")
FULL_STOPS, ASKS = frozenset("。！？｡"), frozenset("!?؟")
LOW_WORD, MID_CAPITAL, SHORT_TOKEN = regex.compile(r"(?<![\p{L}\p{M}'’\-])\p{Ll}[\p{L}\p{M}'’\-]*"), regex.compile(r"(?<=[\p{Ll},;] )\p{Lu}[\p{L}\p{M}'’\-]*"), regex.compile(r"(?<![\p{L}.])([\p{L}.]{1,6})\.(?= \p{Ll})")
CASELESS = regex.compile(r"[\p{Arabic}\p{Hangul}\p{Devanagari}\p{Hebrew}]")
WORD = regex.compile(r"[\p{L}\p{M}][\p{L}\p{M}'’\-]*")
# Openings that go on with the sentence before, in Thai and after CJK quotations.
THAI_UNITS = ("วัน", "นาที", "ลัง", "ชั่วโมง", "กก", "กิโล", "เปอร์เซ็นต์", "ครั้ง", "ปี", "เดือน", "บาท", "คน", "ชิ้น", "แถว", "น.")
THAI_GO_ON = ("และ", "แต่", "หรือ", "ที่", "ซึ่ง", "ทุก", "ประมาณ", "จึง", "เพราะ", "ถ้า")
CJK_GO_ON = "，、：；,;:とのはがをにでもやかっ的是这那地得吗呢等说問问道）」』”》"


def lines_of(text: str) -> list[tuple[int, int]]:
    """Stretches between hard line breaks; lines that were wrapped stay together."""
    out = []
    for block in BLOCK.finditer(text):
        spans = [m.span() for m in LINE.finditer(block[0])]
        width = max(b - a for a, b in spans)
        start = None
        for i, (a, b) in enumerate(spans):
            line = block[0][a:b]
            if not line.strip():
                if start is not None:
                    out.append((block.start() + start, block.start() + spans[i - 1][1]))
                    start = None
                continue
            start = a if start is None else start
            wrapped = False
            if i + 1 < len(spans):
                after = block[0][spans[i + 1][0] : spans[i + 1][1]]
                first = after.split(None, 1)[0] if after.strip() else ""
                room = (b - a) + 1 + len(first) > width
                wrapped = bool(first) and room and width >= 30 and not LIST.match(after) and not after.lstrip().startswith("#") and not line.lstrip().startswith("#") and not (CJK.search(line[-1]))
            if not wrapped:
                out.append((block.start() + start, block.start() + b))
                start = None
    return out


def _before(text: str, start: int, at: int) -> str:
    """The token that ends at a stop, without opening marks."""
    k = at
    while k > start and not text[k - 1].isspace() and text[k - 1] not in "([{“„«‘\"—–/":
        k -= 1
    token = text[k:at]
    if len(token) <= 2 and k - 3 >= start and text[k - 1].isspace() and text[k - 2] == "." and len(token.strip(".")) == 1:
        j = k - 2
        while j > start and not text[j - 1].isspace() and text[j - 1] not in "([“„«":
            j -= 1
        if len(text[j : k - 2]) <= 2:  # spaced abbreviations: d. h., p. ex., u. a.
            token = f"{text[j : k - 2]}.{token}"
    return token


def is_small(text: str) -> bool:
    """A text of a cased script in small letters only, or in capitals only: its case tells nothing."""
    return bool(SMALL.search(text)) != bool(CAPITAL.search(text))


class Context:
    """What the document, and where it is silent the corpus, says about tokens and words."""

    def __init__(self, text: str, abbreviations: frozenset, plain: frozenset, lead: frozenset, close: frozenset, full: frozenset) -> None:
        self.small = is_small(text)
        self.low: set[str] = set(LOW_WORD.findall(text)) if not self.small else set()
        self.abbreviations, self.plain = abbreviations, plain
        self.lead, self.close, self.full = lead, close, full
        mid = MID_CAPITAL.findall(text)
        self.proper = {w.lower() for w in mid}
        self.short = {m.lower() for m in SHORT_TOKEN.findall(text)} if not self.small else set()

    def leading(self, token: str) -> bool:
        t = token.lower().strip(".").replace("’", "'").rsplit("'", 1)[-1]
        if t in self.lead or t in self.close or t in self.full:  # the corpus has seen it often enough
            return t in self.lead
        if t in LEADING:
            return True
        if len(t) == 1 and token[-1].isupper() and not self.small:
            return True
        return t not in CLOSING and 1 < len(t) <= 6 and (t in self.abbreviations or (t in self.short and t not in self.plain and len(t) <= 4))

    def closing(self, token: str) -> bool:
        t = token.lower().strip(".")
        if t in self.lead or t in self.close or t in self.full:
            return t in self.close
        return t in CLOSING or bool(DOTTED.fullmatch(t))

    def starts(self, word: str) -> bool:
        """A capitalised word that is no proper name."""
        w = word.lower()
        if w in self.low or w.split("'")[0] in self.low:
            return True
        if w in self.proper:
            return False
        return w in self.plain


def _open_marks(text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """(opening, closing) of the quotations and brackets in a line."""
    out, stack = [], []
    for i in range(start, stop):
        c = text[i]
        if c in OPENERS and not (c == "“" and stack and stack[-1][1] == "“"):
            if c == "‘" and i > start and text[i - 1].isalnum():
                continue
            stack.append((i, OPENERS[c]))
        elif stack and c == stack[-1][1] and not (c == "’" and i + 1 < stop and text[i + 1].isalnum()):
            out.append((stack.pop()[0], i))
        elif c in "\"'":
            left = i == start or text[i - 1].isspace() or text[i - 1] in "([—"
            right = i + 1 >= stop or not text[i + 1].isalnum()
            if stack and stack[-1][1] == c and right and not left:
                out.append((stack.pop()[0], i))
            elif left and not right:
                stack.append((i, c))
    return out


def split_line(text: str, start: int, stop: int, ctx: Context) -> list[int]:
    """Ends of the sentences inside one line (exclusive positions)."""
    body = MARKER.match(text, start, stop).end()
    marks = [(a, b) for a, b in _open_marks(text, body, stop) if b - a > 1]
    ends: list[int] = []
    first = body

    def skip(i: int) -> int:
        while i < stop and text[i].isspace():
            i += 1
        return i

    def inside(i: int) -> tuple[int, int] | None:
        held = [(a, b) for a, b in marks if a <= i < b and a >= first - 1]
        return min(held, default=None)

    sites = [(m.start(), m.end(), "stop") for m in STOPS.finditer(text, body, stop)]
    if UNSPACED.search(text, body, stop):  # only there a blank alone may end a sentence
        sites = sorted(sites + [(m.start(), m.end(), "space") for m in SPACES.finditer(text, body, stop)])
    for a, b, kind in sites:
        if a < first:
            continue
        if kind == "space":
            if inside(a) or b >= stop:
                continue
            left, right = text[a - 1], text[b]
            if CJK.match(left) and (CJK.match(right) or right in "「『（“《" or right.isdigit()):
                ends.append(a)
                first = b
            elif (THAI.match(left) or left in "”\"»" or left.isdigit()) and THAI.search(text, first, a):
                chunk = CHUNK.match(text, b, stop)[0]
                token = LAST_CHUNK.search(text, first, a)[0]
                if token.endswith("."):
                    continue
                long_enough = len(chunk) >= 8 and THAI.search(chunk) and not chunk[0].isdigit() and chunk[0] not in "“\"«("
                number_start = chunk[0].isdigit() and not token[-1].isdigit() and NUMBER_CHUNK.search(text, first, a) and NUMBER_THAI.match(text, b, stop)
                paren = chunk[0] in "(“" and stop - b > 12 and chunk[0] == "("
                if left.isdigit() and chunk.startswith(THAI_UNITS):
                    continue
                if (long_enough or number_start or paren) and not chunk.startswith(THAI_GO_ON):
                    if not (left in "”\"»" and chunk.startswith(THAI_GO_ON)):
                        ends.append(a)
                        first = b
            continue
        mark = text[a:b]
        end = b
        held = inside(a)
        closed = None
        while True:  # closing quotes, brackets and note marks belong to the sentence
            n = NOTE.match(text, end, stop)
            if n:
                end = n.end()
                continue
            if end < stop and text[end] in CLOSE and not (text[end] in "'’\"" and end + 1 < stop and text[end + 1].isalnum() and not CJK.match(text[end + 1])):
                if text[end] in "\"'" and not any(y == end for _, y in marks) and end > b - 1 and (end + 1 < stop and not text[end + 1].isspace()):
                    break
                closed = next((m for m in marks if m[1] == end), closed)
                end += 1
                continue
            if end + 1 < stop and text[end] in "   " and text[end + 1] in "»”" and any(y == end + 1 for _, y in marks):
                closed = next(m for m in marks if m[1] == end + 1)
                end += 2
                continue
            break
        if held and not (closed and closed[0] <= held[0]):
            continue  # the quotation or bracket goes on
        nxt = skip(end)
        if nxt >= stop:
            continue
        gap = nxt > end
        c = text[nxt]
        peek = nxt
        while peek < stop and (text[peek] in OPENERS or text[peek] in "\"'¿¡"):
            peek += 1
        lead = text[peek] if peek < stop else ""
        word = m[0] if (m := WORD.match(text, peek, stop)) else ""
        capital = bool(lead) and not ctx.small and (lead.isupper() or lead.isdigit() or (len(word) > 1 and word[0].islower() and any(x.isupper() for x in word[1:])))
        caseless = bool(CJK.match(lead) or CASELESS.match(lead) or THAI.match(lead)) if lead else False
        at_start = closed is not None and text[first : closed[0]].strip() == ""
        colon = closed is not None and text[first : closed[0]].rstrip()[-1:] in (":", "：")
        bracket = closed is not None and text[closed[0]] in "([（"
        if not FULL_STOPS.isdisjoint(mark):
            if closed and not bracket and (at_start or c in CJK_GO_ON or (not colon and not gap)):
                continue
            if c in "，、：；":
                continue
        elif mark[0] in "।॥":
            if closed and not bracket and not colon:
                continue
        elif set(mark) <= {"…"} or (mark.startswith("..") and set(mark) == {"."}):
            said = text[first:a].strip(" “\"")
            if CJK.match(text[a - 1]) or CJK.match(lead or " "):
                if len(said) <= 4 or c in "，、":
                    continue
            elif not gap or not (capital or ctx.small or caseless or c in "¿¡“„«\"(") or (len(said) <= 5 and " " not in said):
                continue
            elif ctx.small and len(said) <= 12 and " " not in said:
                continue
        elif "." in mark and ASKS.isdisjoint(mark):
            token = _before(text, first, a)
            if lead and THAI.match(lead) and not closed:
                continue  # Thai writes no full stop
            if closed and not bracket and not gap and caseless:
                continue
            if not gap:
                left = STUCK.search(text, first, a if not closed else end)
                stuck = bool(left) and (len(left[0]) >= 2 or ord(left[0]) > 0xC0) and "." not in token and not ADDRESS.search(token)
                after = word
                if not (stuck and ((lead.isupper() and len(after) > 1 and (after[1:2].islower() or after[1:2] in "'’") or (len(after) == 1 and text[peek + 1 : peek + 2] == " ")) or (c in "¿¡“„«" and lead.isupper()) or (caseless and not THAI.match(lead))) and not ctx.leading(token) and not (token.isdigit() and lead.isdigit())):
                    continue
            else:
                if closed and not bracket:
                    if caseless or ctx.small:
                        if not colon:
                            continue
                    elif not capital and c not in "¿¡“„«\"(":
                        continue
                elif bracket and not at_start and not capital:
                    continue
                elif not closed:
                    if ctx.leading(token) or (len(token) == 1 and token.isupper()):
                        continue
                    if not (capital or caseless or ctx.small or c in "¿¡“„«\"'(‘[#*-–—"):
                        continue
                    if ctx.closing(token) and not caseless:
                        if lead.isdigit():
                            continue
                        if ctx.small:
                            if token.lower().strip(".") not in ("etc", "v.v"):
                                continue
                        elif not ctx.starts(word):
                            continue
                    if token.isdigit() and len(token) <= 2 and word.lower() in MONTHS:
                        continue
        else:  # ! ? and their Arabic forms
            if closed and not bracket:
                if at_start and not capital or ((caseless or ctx.small) and not colon):
                    continue
                if not capital and c not in "¿¡“„«\"(" and not caseless and not ctx.small:
                    continue
            elif not gap:
                if not (capital or c in "¿¡“„«" or caseless):
                    continue
            elif not (capital or caseless or ctx.small or c in "¿¡“„«\"'(‘[*-–—#"):
                continue
            if c in ",;:":
                continue
        ends.append(end)
        first = nxt
    tail = text[first:stop].rstrip()
    if tail:
        ends.append(first + len(tail))
    return ends


NONE: frozenset = frozenset()


def sentence_ends(text: str | None, abbreviations: frozenset = NONE, plain: frozenset = NONE, lead: frozenset = NONE, close: frozenset = NONE, full: frozenset = NONE) -> list[int]:
    """Exclusive end of every sentence, in code points. What the corpus says: tokens before a stop that small letters or
    numbers follow (abbreviations), words that are no proper names (plain), abbreviations that never (lead) or at times
    (close) end a line, and words whose stop is a full stop (full)."""
    if not text or not text.strip():
        return []
    ctx = Context(text, abbreviations, plain, lead, close, full)
    return [e for a, b in lines_of(text) for e in split_line(text, a, b, ctx)]


EVIDENCE = regex.compile(r"(?<![\p{L}.])((?:\p{L}\.){0,3}[\p{L}\p{M}]{1,6})\.(?:(?= (\p{Ll}|\p{N}))|(?=[”’»)\]\"']*(\s*$))|)", regex.M)
BARE = regex.compile(r"(?<![\p{L}\p{M}.])\p{L}{1,6}(?![\p{L}\p{M}.])")
AFTER_STOP = regex.compile(r"\. [“„«\"'(]*(\p{Lu}[\p{L}\p{M}'’\-]*)")
PLAIN_WORD = regex.compile(r"(?<=[\p{L},] )\p{Ll}[\p{L}\p{M}'’\-]*|(?<=\p{Ll}{4}[.!?] |^)\p{Lu}[\p{L}\p{M}'’\-]*", regex.M)
NAME_WORD = regex.compile(r"(?<=\p{Ll},? )\p{Lu}[\p{L}\p{M}'’\-]*")


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each text: short tokens with how often they stand before a stop, how often small letters or numbers follow it,
    how often it ends a line, and how often they stand without one; words with how often they stand in small letters or
    open a sentence after a plain word, and how often they are capitalised inside one."""
    counts: dict[tuple[str, str], list[int]] = {}

    def flush() -> pd.DataFrame:
        out = pd.DataFrame([(k, t, *n) for (k, t), n in counts.items()], columns=["kind", "token", "n", "small", "last", "bare"])
        counts.clear()
        return out

    for b in batches:
        for text in b["text"].dropna():
            if is_small(text):
                continue
            for m in EVIDENCE.finditer(text):
                n = counts.setdefault(("token", m[1].lower()), [0, 0, 0, 0])
                n[0] += 1
                n[1] += m[2] is not None
                n[2] += m[3] is not None
            for w in BARE.findall(text):
                counts.setdefault(("token", w.lower()), [0, 0, 0, 0])[3] += 1
            for w in PLAIN_WORD.findall(text):
                counts.setdefault(("word", w.lower()), [0, 0, 0, 0])[0] += 1  # in small letters, or at a plain start
            for w in NAME_WORD.findall(text):
                counts.setdefault(("word", w.lower()), [0, 0, 0, 0])[1] += 1
        if len(counts) > 100_000:
            yield flush()
    yield flush()


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, text in zip(b["doc_id"], b["text"], strict=True):
            rows += [(i, "token", t) for t in {m[1].lower() for m in EVIDENCE.finditer(text)}]
            rows += [(i, "word", w) for w in {m[1].lower() for m in AFTER_STOP.finditer(text)} | {m[1].lower() for m in EVIDENCE.finditer(text)}]
        yield pd.DataFrame(rows, columns=["doc_id", "kind", "token"])


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, text, known in zip(b["doc_id"], b["text"], b["known"], strict=True):
            known = list(known) if known is not None else []
            said: dict[str, set] = {"token": set(), "word": set(), "lead": set(), "close": set(), "full": set()}
            for k in known:
                kind, _, t = k.partition(":")
                said[kind].add(t)
            last = 0
            for e in sentence_ends(text, said["token"], said["word"], said["lead"], said["close"], said["full"]):
                sentence = text[last:e].strip()
                rows.append((i, e, sentence))
                last = e
        yield pd.DataFrame(rows, columns=["doc_id", "end_pos", "sentence"])


def split_sentences(documents: DataFrame, least: int = 4, share: float = 0.6, often: int = 8) -> DataFrame:
    """documents(doc_id, text) -> doc_id, end_pos, sentence.

    A token seen before a stop at least often times is settled by the corpus: an abbreviation if small letters or numbers
    follow it in that share of cases, or if it never stands without the stop and hardly ever ends a line; a plain word if it
    mostly stands without. The fixed lists speak only where the corpus is silent. What the corpus says about a token goes to the documents that hold it by a join, so nothing
    that grows with the corpus sits in one place.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and trim(text) <> ''")
    docs = cut(docs.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).drop("h"), "documents")
    counted = docs.select("text").mapInPandas(_evidence, "kind string, token string, n long, small long, last long, bare long")
    counted = counted.groupBy("kind", "token").agg(*[F.sum(c).alias(c) for c in ("n", "small", "last", "bare")])
    n, small, last, dotted = F.col("n"), F.col("small"), F.col("last"), F.col("n") / (F.col("n") + F.col("bare"))
    word, settled = F.col("kind") == "word", (F.col("kind") == "token") & ((F.length("token") > 1) | (F.upper("token") == F.col("token"))) & (F.col("n") >= often)
    small_after, always = small >= share * n, dotted >= 0.9
    leads = small_after & (last <= 0.02 * n) | always & (n >= 4 * often) & (last <= 0.05 * n)
    closes = small_after | always & (small >= 0.1 * n)
    says = F.when(word & (n >= 3) & (small <= 0.2 * n), "word").when(settled & leads, "lead").when(settled & closes, "close")
    says = says.when(settled & (dotted < 0.3) & (small < 0.2 * n), "full").when(~word & (n >= least) & (small >= share * n), "token")
    stats = cut(counted.select(says.alias("kind"), "token").where("kind is not null"), "tokens")
    asked = docs.mapInPandas(_asked, "doc_id long, kind string, token string").distinct()
    known = asked.join(stats.withColumnRenamed("kind", "says"), "token").where((F.col("kind") == "word") == (F.col("says") == "word"))
    known = known.groupBy("doc_id").agg(F.collect_set(F.concat("says", F.lit(":"), "token")).alias("known"))
    return docs.join(known, "doc_id", "left").select("doc_id", "text", "known").mapInPandas(_split_batches, "doc_id long, end_pos int, sentence string").dropDuplicates(["doc_id", "end_pos"])
