"""Personal information inside free text: find it and put typed placeholders in its place.

An Aho-Corasick automaton finds anchors (at-signs, schemes, digits, street words, identifier cues); from each kind of
anchor local parsers expand to the e-mail address, postal address, identity or phone number and check its shape and,
where it has them, its check digits. Names have no anchor of their own. They are learned over the whole corpus by
mutual bootstrapping: general cues (titles, greetings, signatures, self-introductions, field labels) give the first
name words; contexts of two words in which runs of capitals mostly hold known name words become cues themselves; what
they announce gives further name words. Then runs of those words are marked. Name words and cues reach a text by a
join on the words it holds.

Undefined cases: a null or blank text has no occurrence; rows repeated under one key count once; overlapping finds
go to the earlier kind of KINDS; texts are scanned whole, however long; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.functions.text import fold
from tomeline.llm.language import LATIN_TEXT, fold_word
from tomeline.session import cut

KINDS = ("email", "address", "id_number", "phone", "name")
PLACEHOLDER = {"email": "[EMAIL]", "address": "[ADDRESS]", "id_number": "[ID_NUMBER]", "phone": "[PHONE]", "name": "[NAME]"}
# Words that open or close a postal address.
STREETS = ("lane", "terrace", "row", "st", "street", "road", "rd", "avenue", "ave", "blvd", "boulevard", "close", "court", "drive", "square", "way", "crescent", "gardens", "hill", "mews", "parade", "place", "quay")
BEFORE_NAME = ("rue", "avenue", "place", "chemin", "boulevard", "quai", "impasse", "calle", "avenida", "plaza", "paseo", "đường", "duong", "lối", "loi", "phố", "pho", "thôn", "thon", "ấp", "bản")
AFTER_NAME = ("weg", "straße", "strasse", "str.", "gasse", "allee", "platz")
SPOKEN_WORDS = ("zero", "oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
# Schemes, and words that announce an identity number.
SCHEMES = ("mailto:", "tel:", "sms:", "sip:", "callto:")
ID_CUES = ("ssn", "social security", "dni", "nif", "nie", "cpf", "cccd", "cmnd", "căn cước", "passport", "reisepass", "passeport", "pasaporte", "hộ chiếu", "personalausweis", "身份证", "national insurance", "aadhaar", "identity no", "identity number", "id number", "tax id")
ANCHORS = {
    "email": ("@", "＠", " at ", "at)", "at]", "at )", "at ]"),
    "address": (*(f" {s}" for s in STREETS), "box", *(f"{w} " for w in (*BEFORE_NAME, *AFTER_NAME)), "ngõ", "ngo ", "号", "號"),
    "number": tuple("0123456789"),
    "spoken": SPOKEN_WORDS,
    "scheme": SCHEMES,
    "cue": ID_CUES,
}
I = regex.I
AT = regex.compile(r"\s?(?:@|＠|[\[(]\s*(?:@|at)\s*[\])])\s?", I)
SAID_AT = regex.compile(r" (?:at|\(at\)|\[at\]) (?=[\p{L}\p{N}\-]+ (?:dot|\(dot\)|\[dot\]) )", I)
LOCAL_PART = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+\-]*", regex.REVERSE)
DOMAIN = regex.compile(r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?)*\.\p{L}{2,}")
SAID_DOMAIN = regex.compile(r"[\p{L}\p{N}\-]+(?: (?:dot|\(dot\)|\[dot\]) [\p{L}\p{N}\-]+)+", I)
W = r"[\p{L}\p{M}'’\-]+"
SEP = r"(?:\s*[,;]\s*|\s*[\r\n]+\s*)"
CITY = rf"(?-i:\p{{Lu}}[\p{{L}}\p{{M}}'’\-]+(?:[ ]\p{{Lu}}[\p{{L}}\p{{M}}'’\-]+)?|(?<=^[^\p{{Lu}}]*)\p{{Ll}}+(?:[ ]\p{{Ll}}+)?(?=\s*(?:[.,;:?!)\"\n]|$)))"
UNIT = r"(?:apt|unit|flat|suite|apartment|floor)\.?\s*\d+\p{L}?"
TOWN = r"(?-i:\p{Lu}[\p{L}\p{M}'’\-]+(?=\s*(?:[.,;:?!)\"\n]|$)|[ ]\p{Ll}))"
CODE = r"(?:[ ]+(?:\p{Lu}{1,2}\d{1,2}\p{L}?[ ]?\d\p{L}{2}|\d{5}(?:-\d{4})?))?"
VN_AREA = r"(?:phường|phuong|quận|quan|thị trấn|thi tran|xã|xa|huyện|huyen|thành phố|thanh pho|tp\.?|tỉnh|tinh)"
VN_NAME = rf"(?-i:(?:\p{{Lu}}[\p{{L}}\p{{M}}]*)(?:[ ]\p{{Lu}}[\p{{L}}\p{{M}}]*){{0,2}}|\p{{Ll}}[\p{{L}}\p{{M}}]*(?:[ ]\p{{Ll}}[\p{{L}}\p{{M}}]*)?)"
ADDRESS = regex.compile(
    rf"(?:(?:{UNIT}|c/o[^,\n]{{1,30}}){SEP}?\s*)?(?<![\p{{L}}\p{{N}}/.])\d{{1,5}}(?:-\d{{1,5}})?\p{{L}}?[ ]+(?:{W}[ ]+){{1,3}}?(?:{'|'.join(STREETS)})\b\.?(?-i:[ ](?:NW|NE|SW|SE|N|S|E|W)\b)?(?:{SEP}{UNIT})?(?:{SEP}{CITY}{CODE})?"
    rf"|\bp\.?\s?o\.?\s?box[ ]+\d+(?:{SEP}{CITY}{CODE})?"
    rf"|(?<![\p{{N}}/])\d{{1,4}}(?:[ ](?:bis|ter|quater))?,?[ ](?:rue|avenue|place|chemin|boulevard|quai|impasse)[ ](?:des?[ ]|du[ ]|de[ ]la[ ]|d['’]|l['’])*{W}(?:[ ]\p{{Lu}}{W})?(?:{SEP}(?:\d{{5}}[ ]{W}|{TOWN}))?"
    rf"|\b(?:calle|avenida|plaza|paseo)[ ](?:de[ ]la[ ]|del[ ]|de[ ]|la[ ]|el[ ])?{W}(?:[ ]{W})?,?[ ](?:n\.?º[ ]?)?\d{{1,4}}(?:{SEP}\d{{1,2}}[ºª°o]?[ ]?\p{{L}}?\b)?(?:{SEP}\d{{5}}[ ]{W})?"
    rf"|\b\p{{L}}{{3,}}(?:weg|straße|strasse|str\.|gasse|allee|platz)[ ]\d{{1,4}}\p{{L}}?\b(?:{SEP}\d{{5}}[ ]{W})?"
    rf"|(?:\b(?:số|so)[ ])?(?<![\p{{N}}/])\d{{1,4}}(?:/\d{{1,4}})*(?:[ ](?:ngõ|ngo|hẻm|hem|ngách|ngach)[ ]\d{{1,4}}(?:/\d{{1,4}})*)?[ ,]+(?:đường|duong|lối|loi|phố|pho)[ ]{VN_NAME}(?:{SEP}{VN_AREA}[ ]*{VN_NAME})*"
    rf"|\b(?:thôn|thon|ấp|bản)[ ]{VN_NAME}(?:{SEP}{VN_AREA}[ ]*{VN_NAME})+"
    r"|(?:\p{Han}{2,12}?[省市区縣县](?=\p{Han})){0,4}\p{Han}{1,10}(?:路|街|道|巷|弄|大街|胡同)(?:\p{Han}{1,6})?\d{1,5}[号號](?:院|楼)?(?:\d{1,4}(?:号楼|栋|单元|层|楼|室)){0,4}",
    I,
)
ID = regex.compile(
    r"(?<![\p{L}\p{N}+.\-/])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\p{L}{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{2}\d{7}|\d{3} \d{3} \d{3} \d{3}|\d{12}|\d{6}[-+A]\d{4}X?|\d{6}[-+A]\d{3}\p{L})(?![\p{L}\p{N}]|[-./]\d)",
    I,
)
AFTER_CUE = regex.compile(r"\W*(?:(?:no|nr|number|card|número|số|is|ist|est|es|là|号|号码)\W*){0,3}(?=[\p{L}\p{N}.\-/ ]*\p{N})((?:\p{L}{0,3}[ .\-/]?)?\p{N}{2,}(?:[ .\-/]?\p{N}+)*(?:-?\p{L}\b)?)", I)
CHECKED = regex.compile(r"(?<![\p{L}\p{N}+.\-/])(?:\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d{17}[\dXx]|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{11})(?![\p{L}\p{N}]|[-./]\d)")
ID_CUE = regex.compile(r"(?<!\p{L})(?:" + "|".join(ID_CUES) + r")(?![a-z])", I)
TEL = regex.compile(r"(?:tel|sms|sip|callto):(\+?[\d().\- ]{5,}\d)", I)
# Words before a number that is no phone or identity number.
OTHER_NUMBER = regex.compile(r"(?:isbn(?: is)?|shelf (?:no\.?|number)|kệ số|ticket|mã phiếu|lot|lô|build|bản|section|mục|price|giá|sku|rack|room|phòng|page|error|lỗi|call number|order|invoice|iban|ratio is|version|ref(?:erence)?\.?|track(?:ing)?|barcode|serial)\s*(?:no\.?|number|#|:)?\s*$", I)
PHONE_CUE = regex.compile(r"(?:tel|phone|fax|call|text|mobile|ring|☎|📞|sđt|điện thoại|gọi (?:tôi )?(?:theo )?số|số (?:của tôi )?(?:là)?|appelez le|llame al|anrufen|rufen sie|reach me (?:at|on)|on|under|at)\W*(?:is|là)?\W*$", I)
PHONE = regex.compile(r"(?<![\p{L}\p{N}@._/#])(?:\+|00)?\(?\d{1,15}\)?(?:(?:\.(?=[\d(])|[ \-]| ?/ ?)\(?\d{1,8}\)?\d{0,8}){0,6}(?![\p{L}\p{N}@_]|[-./]\d)")
SPOKEN = regex.compile(rf"\b(?:(?:{'|'.join(SPOKEN_WORDS)})\b[ ,\-]*){{7,}}", I)
SHAPES = regex.compile(
    r"^(?:(?:\+|00)[\d ().\-/]{8,}|0\d{4} ?\d{6}|0\d{3} ?\d{3} ?\d{4}|0\d(?:[ .]\d{2}){4}|\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}|\(0\d{1,4}\) ?\d{3,4} ?\d{3,4}|1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}|555-\d{4}|0\d{2,3} ?/ ?\d{4,8}(?: \d{2,4})?)$"
)
TITLE = r"(?:mr|mrs|ms|mx|miss|dr|prof|herr|frau|hr|fr|mme|mlle|señora?|sra?|sr|ông|bà|anh|chị)"
HONORIFIC = frozenset("mr mrs ms mx miss dr prof herr frau mme mlle m señor señora sr sra don doña".split())
# General wordings right before a name (matched backwards, from the name on).
BEFORE = regex.compile(
    r"(?:\b(?:thank you|thanks|cảm ơn|merci|danke|gracias),?|\b(?:hello|hi|hey|dear|bonjour|hallo|hola|chào|liebe[rs]?|chère?|estimad[oa])|\b(?:signed|regards|sincerely|best|yours|cheers|cordialement|grüßen?|saludos|atentamente|trân trọng|ký tên),?\s"
    r"|\b(?:my name is|this is|i'?m|i am|ich heiße|ich bin|mein name ist|je m'?appelle|je suis|me llamo|soy|tôi tên là|tên tôi là|tôi là|who is|ai là)"
    r"|\b(?:my|our) (?:colleague|manager|friend|neighbou?r|wife|husband|brother|sister|daughter|son|boss|assistant)|\b(?:ask for|speak (?:to|with)|talk to|forward to|deliver(?:y)? to|ship to|attn\.?|attention|c/o|lieferung an|livrez à|entregue a|liên hệ|contact|from|cc|to):?"
    r"|\"?\b(?:name|holder|owner|customer|contact|author|sender|recipient)\"? ?[:=] ?\"?)[ ]*$",
    I | regex.REVERSE,
)
# Words that open a sentence before a name and are none themselves.
NO_NAME = frozenset("yesterday hier for ayer gestern i'm mr mrs ms mx dr mme frau herr signed noted is rufen don who this contact ask the a an and or our your his her der die das ein eine le la les un une el los las una im dear hello hi hey thank thanks regards sincerely best cheers bonjour hallo hola chao merci danke gracias hôm qua nha lien he ich je me my".split())
TOKEN = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
LATIN_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
SIX_DIGITS = re.compile(r"\d(?:[ \-./()]{0,5}\d){5}")  # every identity and phone number in figures holds such a run
CAPITALS = regex.compile(r"\p{Lu}(?:\.[ \u00a0]|[\p{L}\p{M}'’]*[ \-]\p{Lu})")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in ANCHORS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _anchored(text: str) -> set[str]:
    """The kinds of anchors that a text holds."""
    low = text.lower()
    kinds: set[str] = set()
    for end, (kind, n) in _automaton().iter(low):
        if kind not in kinds and not (low[end + 1 : end + 2].isalpha() and (kind == "spoken" or kind == "address" and low[end - n + 1] == " ")):
            kinds.add(kind)  # and not only the beginning of a longer word
    return kinds


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From every at-sign outwards: the local part before it, the domain after it."""
    for at, domain in ((AT, DOMAIN), (SAID_AT, SAID_DOMAIN)):
        for m in at.finditer(text):
            before = LOCAL_PART.match(text, 0, m.start())
            after = domain.match(text, m.end())
            if before and after:
                start = before.start()
                yield (start - 7 if text[:start].lower().endswith("mailto:") else start), after.end()


def _dni(code: str) -> bool:
    digits = code[:-1].replace("-", "").translate({88: "0", 89: "1", 90: "2"})
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == code[-1]


def _weighted(digits: str, first: int) -> int:
    return sum(int(d) * w for d, w in zip(digits, range(first, 1, -1))) * 10 % 11 % 10


def has_check_digits(code: str) -> bool:
    """Whether an identity number that carries check digits has the right ones (Spanish, Chinese, Brazilian ones)."""
    bare = code.replace(".", "").replace("-", "").upper()
    if not code[-1].isdigit() and len(bare) == 9:
        return _dni(bare)
    if len(bare) == 18:
        return "10X98765432"[sum(int(d) * (2 ** (17 - i) % 11) for i, d in enumerate(bare[:17])) % 11] == bare[17] and bare[6:8] in ("19", "20")
    return len(bare) == 11 and len(set(bare)) > 1 and bare[9] == str(_weighted(bare[:9], 10)) and bare[10] == str(_weighted(bare[:10], 11))


def _words(text: str) -> re.Pattern:
    return LATIN_TOKEN if LATIN_TEXT.match(text) else TOKEN


def _is_honorific(word: str) -> bool:
    return word.lower() in HONORIFIC


def _free(taken: list[tuple[int, int, str]], a: int, b: int) -> bool:
    return all(b <= s or a >= e for s, e, _ in taken)


def numbers_and_addresses(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of everything but names."""
    taken: list[tuple[int, int, str]] = []
    anchors = _anchored(text)
    if not anchors:
        return taken

    def take(start: int, end: int, kind: str) -> None:
        end = start + len(text[start:end].rstrip(" ,;-\n\r"))
        if end > start and _free(taken, start, end):
            taken.append((start, end, kind))

    def search(pattern, kind: str, ok=lambda m: True) -> None:
        for m in pattern.finditer(text):
            if m.end() > m.start() and ok(m):
                take(m.start(), m.end(), kind)

    if "email" in anchors:
        for start, end in _emails(text):
            take(start, end, "email")
    if "address" in anchors:
        search(ADDRESS, "address")
    plain = lambda m: not OTHER_NUMBER.search(text[max(0, m.start() - 24) : m.start()])
    in_figures = "number" in anchors and SIX_DIGITS.search(text)
    if in_figures:
        search(ID, "id_number", plain)
        search(CHECKED, "id_number", lambda m: plain(m) and has_check_digits(m[0]))
        if "cue" in anchors:
            for c in ID_CUE.finditer(text):
                m = AFTER_CUE.match(text, c.end())
                if m and 6 <= sum(x.isdigit() for x in m[1]) <= 18:
                    take(*m.span(1), "id_number")
        if "scheme" in anchors:
            for m in TEL.finditer(text):
                take(*m.span(1), "phone")

    def is_phone(m) -> bool:
        digits = sum(c.isdigit() for c in m[0])
        before = text[max(0, m.start() - 32) : m.start()]
        if not 7 <= digits <= 15 or OTHER_NUMBER.search(before):
            return False
        bare = m[0].strip()
        bare = bare[1:] if bare.count("(") > bare.count(")") else bare[:-1] if bare.count(")") > bare.count("(") else bare
        bare = bare[1:-1] if regex.match(r"\([^()]*\)$", bare) else bare
        return bool(SHAPES.match(bare) or (PHONE_CUE.search(before) and digits >= 8 and not regex.match(r"\d{1,2}[./]\d{1,2}[./]\d{2,4}$", m[0])))

    if in_figures:
        search(PHONE, "phone", is_phone)
    if "spoken" in anchors:
        search(SPOKEN, "phone")
    return taken


def _tokens(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, word, folded word) outside what is taken."""
    if not taken:
        return [(m.start(), m.end(), m[0], fold_word(m[0])) for m in _words(text).finditer(text)]
    out, spans = [], sorted(taken)
    k = 0
    for m in _words(text).finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k < len(spans) and m.start() < spans[k][1] and m.end() > spans[k][0]:
            continue
        out.append((m.start(), m.end(), m[0], fold_word(m[0])))
    return out


def _joined(text: str, a: tuple, b: tuple) -> bool:
    return text[a[1] : b[0]] in (" ", "-", "  ", "\u00a0", ". ", ".\u00a0")


def _cues(toks: list[tuple[int, int, str, str]], i: int, j: int) -> tuple[str, str]:
    """The two words before token i and the two after token j."""
    before, after = toks[max(0, i - 2) : i], toks[j + 1 : j + 3]
    return " ".join(["^"] * (2 - len(before)) + [t[3] for t in before]), " ".join([t[3] for t in after] + ["$"] * (2 - len(after)))


def _roles(text: str, run: list[tuple[int, int, str, str]]) -> list[str]:
    """role:word of the words of a run of capitals, if it is a name."""
    if _is_honorific(run[0][2]):
        return [f"sur:{run[-1][3]}"] if len(run) in (2, 3) else []
    spaced = all(text[a[1]] == " " for a in run[:-1])
    if len(run) == 3 and spaced and all(1 < len(r[3]) <= 6 for r in run):
        return [f"vn{k}:{r[3]}" for k, r in enumerate(run, 1)]
    if len(run) in (2, 3) and len(run[-1][3]) > 1 and len(run[0][3]) > 1:
        return [*(f"given:{r[3]}" for r in run[:-1] if len(r[3]) > 1), f"sur:{run[-1][3]}"]
    return [f"given:{run[0][3]}"] if len(run) == 2 and len(run[1][3]) == 1 else []


def _may_hold_name(text: str) -> bool:
    """Whether two capitals stand side by side or a title stands in a text."""
    return CAPITALS.search(text) is not None or not HONORIFIC.isdisjoint(text.lower().replace(".", " ").split())


def name_runs(text: str, taken: list[tuple[int, int, str]]) -> tuple[list[str], list[tuple[tuple[str, ...], str, str, bool]]]:
    """The folded words of a text; and its runs of capitals that may be names: roles, words before, words after, and
    whether a general cue or a title announces them."""
    if not taken and not _may_hold_name(text):
        return [*map(fold_word, _words(text).findall(text))], []
    toks = _tokens(text, taken)
    out, done = [], 0
    for i, t in enumerate(toks):
        if i < done or not (t[2][0].isupper() or t[2].lower() in HONORIFIC):
            continue
        j = i
        while j + 1 < len(toks) and t[2][0].isupper() and toks[j + 1][2][0].isupper() and text[toks[j][1] : toks[j + 1][0]] in (" ", "-"):
            j += 1
        done, first = j + 1, i
        if j == i and t[2].lower() in HONORIFIC and j + 1 < len(toks) and toks[j + 1][2][0].isupper():
            continue
        first = next((k for k in range(j - 1, i, -1) if _is_honorific(toks[k][2])), first)
        while first < j and toks[first][3] in NO_NAME and not _is_honorific(toks[first][2]):
            first += 1
        # the first word of a sentence may or may not be part of the name
        opens = j - first >= 2 and not _is_honorific(toks[first][2]) and text[max(0, toks[first][0] - 4) : toks[first][0]].rstrip()[-1:] in ("", ".", "!", "?", "。")
        for k in (first, first + 1) if opens else (first,):
            roles = _roles(text, toks[k : j + 1])
            if roles:
                sure = _is_honorific(toks[k][2]) or bool(BEFORE.search(text, max(0, toks[k][0] - 40), toks[k][0]))
                out.append((tuple(roles), *_cues(toks, k, j), sure))
    return [t[3] for t in toks], out


def _like_family_names(seen: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The words of seen(word) that are built from a beginning and an end which at least three known family names have."""
    last = F.length("word") - 3
    family = lexicon.where("role = 'sur'").select("word").distinct()
    at = lambda df, end: df.where(end >= 2).withColumn("k", F.explode(F.sequence(F.lit(2), end)))
    begin, rest = F.expr("substring(word, 1, k)"), F.expr("substring(word, k + 1)")
    starts = at(family, F.least(F.lit(5), last)).groupBy(begin.alias("begin")).agg(F.count("*").alias("n")).where("n >= 3").select("begin")
    ends = at(family, last).groupBy(rest.alias("rest")).agg(F.count("*").alias("n")).where("n >= 3").select("rest")
    split = at(seen.distinct(), last).select("word", begin.alias("begin"), rest.alias("rest"))
    return split.join(starts, "begin", "left_semi").join(ends, "rest", "left_semi").select("word").distinct()


def find_names(text: str, taken: list[tuple[int, int, str]], words: dict[str, frozenset]) -> list[tuple[int, int, str]]:
    given, sur, like, every = words["given"], words["sur"], words["like"], words["every"]
    if not every and not any(w.capitalize() in text or w.upper() in text for w in like) and not _may_hold_name(text):
        return []  # no word that a name could begin with
    toks = _tokens(text, taken)

    def announced(i: int, j: int) -> bool:
        """Whether a general or a learned cue stands before token i or after token j."""
        before, after = _cues(toks, i, j)
        return before in words["left"] or after in words["right"] or bool(BEFORE.search(text, max(0, toks[i][0] - 40), toks[i][0]))

    out, i = [], 0
    while i < len(toks):
        t = toks[i]
        if t[3] not in every and not t[2][0].isupper() and not _is_honorific(t[2]):
            i += 1  # begins no name
            continue
        nxt = toks[i + 1] if i + 1 < len(toks) and _joined(text, t, toks[i + 1]) else None
        # Vietnamese: family name, middle name, given name
        third = toks[i + 2] if nxt and i + 2 < len(toks) and _joined(text, nxt, toks[i + 2]) else None
        if t[3] in words["vn1"] and nxt and third and nxt[3] in words["vn2"] and third[3] in words["vn3"] and (t[2][0].isupper() == third[2][0].isupper()):
            out.append((t[0], third[1], "name"))
            i += 3
            continue
        j = i
        if _is_honorific(t[2]) and nxt and (nxt[3] in sur or nxt[3] in given or (t[2][0].isupper() and nxt[2][0].isupper() and len(t[2]) > 1 and len(nxt[2]) > 2)):
            j = i + 1
        start, kinds = i, []
        while j < len(toks) and (toks[j][3] in given or toks[j][3] in sur or (j > start and len(toks[j][3]) == 1 and kinds)) and (j == start or _joined(text, toks[j - 1], toks[j])):
            kinds.append("i" if len(toks[j][3]) == 1 else "g" if toks[j][3] in given and toks[j][3] not in sur else "s" if toks[j][3] not in given else "b")
            j += 1
            if kinds[-1] == "s" and not (j < len(toks) and toks[j][3] in sur and text[toks[j - 1][1] : toks[j][0]] == "-"):
                if j < len(toks) and len(toks[j][3]) == 1 and toks[j][2].isupper() and text[toks[j - 1][1] : toks[j][0]] == " " and text[toks[j][1] : toks[j][1] + 1] == ".":
                    j += 1
                break
        if kinds and kinds[-1] in "gi" and kinds[0] in "gb" and j < len(toks) and len(toks[j][3]) > 2 and (toks[j][2][0].isupper() or toks[j][3] in like) and toks[j][3] not in NO_NAME and text[toks[j - 1][1] : toks[j][0]] in (" ", ". "):
            kinds.append("s")  # a family name not seen before
            j += 1
        if not kinds and len(t[2]) == 1 and t[2].isupper() and nxt and nxt[2][0].isupper() and text[t[1]] == "." and (nxt[3] in sur or nxt[3] in like or announced(i, i + 1)):
            kinds, j = ["i", "s"], i + 2
        if not kinds and not _is_honorific(t[2]) and t[2][0].isupper() and t[3] not in NO_NAME and len(t[3]) > 3 and t[3] in like and announced(i, i):
            kinds, j = ["s"], i + 1
        if _is_honorific(t[2]) and nxt and not kinds and j == i + 1:
            kinds, j = ["s"], i + 2
        if not kinds and BEFORE.search(text, max(0, t[0] - 40), t[0]):  # a run of capitals right after a general cue
            j = i
            while j < min(i + 4, len(toks)) and toks[j][2][0].isupper() and toks[j][3] not in NO_NAME and (j == i or text[toks[j - 1][1] : toks[j][0]] in (" ", "-") or len(toks[j - 1][3]) == 1 and _joined(text, toks[j - 1], toks[j])):
                j += 1
            place = j > i and any(start - toks[j - 1][1] <= 2 and start >= toks[j - 1][1] and kind == "address" for start, _, kind in taken)
            kinds = ["g", "s"] if j - i >= 2 and not place else []
        if kinds:
            # family name, given name
            if kinds == ["s"] and j < len(toks) and text[toks[j - 1][1] : toks[j][0]] == ", " and toks[j][3] in given and not (j + 1 < len(toks) and _joined(text, toks[j], toks[j + 1]) and toks[j + 1][3] in sur):
                j += 1
                kinds.append("g")
            a, b = toks[start][0], toks[j - 1][1]
            solo = len([k for k in kinds if k != "i"]) == 1 and len(kinds) == 1 and j - start == 1
            if solo and not toks[start][2][0].isupper() and j < len(toks) and _joined(text, toks[j - 1], toks[j]) and _cues(toks, j, j)[1] in words["right"]:
                b, j, solo = toks[j][1], j + 1, False
            if not solo or toks[start][2][0].isupper() or announced(start, j - 1):
                out.append((a, b, "name"))
            i = j
            continue
        i += 1
    return out


SPANS = "array<struct<a:int,z:int,kind:string>>"
EVIDENCE = f"word string, roles array<string>, before string, after string, sure boolean, n long, h long, g long, spans {SPANS}"


def _evidence_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each word stands in the texts, and each run of capitals with its surroundings, summed within the task;
    and what else but names was found in each text."""
    words: Counter = Counter()
    runs: Counter = Counter()
    held: list[tuple] = []
    columns = [c.split()[0] for c in EVIDENCE.split(", ")[:8]] + ["spans"]

    def flush() -> pd.DataFrame:
        rows = [(w, None, None, None, None, n, None, None, None) for w, n in words.items()]
        rows += [(None, list(roles), before, after, sure, n, None, None, None) for (roles, before, after, sure), n in runs.items()]
        rows += [(None, None, None, None, None, None, h, g, [{"a": a, "z": z, "kind": kind} for a, z, kind in spans]) for h, g, spans in held]
        words.clear(), runs.clear(), held.clear()
        # whole numbers beside nulls must not pass through floats, which would change hashes
        return pd.DataFrame({c: pd.array(v, dtype="Int64" if c in ("n", "h", "g") else object) for c, v in zip(columns, zip(*rows) if rows else [()] * len(columns), strict=True)})

    for b in batches:
        for h, g, text, times in zip(b["h"], b["g"], b["text"], b["times"], strict=True):
            taken = numbers_and_addresses(text)
            if taken:
                held.append((h, g, taken))
            found, names = name_runs(text, taken)
            if times == 1:
                words.update(found)
            else:
                for w in found:
                    words[w] += times
            for run in names:
                runs[run] += times
        if len(words) + len(runs) + len(held) > 200_000:
            yield flush()
    yield flush()


RARE = 20_000  # a rare word is at most one in so many
ROLES = ("given", "sur", "vn1", "vn2", "vn3")


def evidence(texts: DataFrame) -> DataFrame:
    """What texts(h, g, text, times) tell of words and names, and the spans of everything else found in each."""
    return texts.select("h", "g", "text", "times").mapInPandas(_evidence_batches, EVIDENCE)


def name_words(told: DataFrame, least: int = 2, share: float = 0.05, learned_share: float = 0.35, rounds: int = 2) -> DataFrame:
    """role, word of what evidence() told: name words announced at least so often, by general cues in at least this share of
    their occurrences or by any in at least learned_share (roles of ROLES), family-like words (like), and the learned cues: two words before (left) or after
    (right) a name.

    A pair of words is a cue if at least three different runs of capitals stand beside it, two or more of which and
    seven in ten hold a known name word. Words and cues are learned from each other in so many rounds.
    """
    seen = cut(told.where("h is null").groupBy("word", "roles", "before", "after", "sure").agg(F.sum("n").alias("n")), "evidence")
    totals = seen.where("word is not null").select("word", F.col("n").alias("total"))
    runs = seen.where("word is null").drop("word")

    def words_of(announced: DataFrame, share: float) -> DataFrame:
        role, word = F.substring_index("r", ":", 1), F.expr("substring(r, instr(r, ':') + 1)")
        counts = announced.select(F.explode("roles").alias("r"), "n").groupBy(role.alias("role"), word.alias("word")).agg(F.sum("n").alias("n"))
        floor = F.when(F.col("role").startswith("vn"), F.lit(0.0)).otherwise(F.lit(share))
        return counts.join(totals, "word").where((F.col("n") >= least) & (F.col("n") >= floor * F.col("total"))).select("role", "word")

    words = cut(words_of(runs.where("sure"), share), "names")
    cues = None
    for _ in range(rounds):
        known = words.select(F.concat("role", F.lit(":"), "word").alias("r"))
        met = runs.select("roles", F.explode("roles").alias("r")).distinct().join(known, "r", "left_semi").select("roles").distinct().withColumn("known", F.lit(1))
        sides = F.explode(F.array(F.struct(F.lit("left").alias("role"), F.col("before").alias("word")), F.struct(F.lit("right").alias("role"), F.col("after").alias("word")))).alias("c")
        last = F.substring_index(F.element_at("roles", -1), ":", -1)  # a run and what is left of it without its first word are one
        beside = runs.select("roles", sides).select("roles", "c.role", "c.word").where("word not in ('^ ^', '$ $')").distinct().join(met, "roles", "left")
        beside = beside.groupBy("role", "word", last.alias("last")).agg(F.max("known").alias("known"))
        cues = beside.groupBy("role", "word").agg(F.count("*").alias("runs"), F.count("known").alias("known")).where("runs >= 3 and known >= 2 and known >= 0.7 * runs").select("role", "word")
        cues = cut(cues, "cues")
        side = lambda name, to: cues.where(F.col("role") == name).select(F.col("word").alias(to), F.lit(True).alias(name))
        announced = runs.join(side("left", "before"), "before", "left").join(side("right", "after"), "after", "left").where("sure or left or right")
        words = cut(words_of(runs.where("sure"), share).unionByName(words_of(announced, learned_share)).distinct(), "names")
    # a word that is common and yet no known name is none because of its parts
    rare = totals.join(F.broadcast(totals.agg(F.sum("total").alias("all"))), F.col("total") * RARE <= F.greatest("all", F.lit(20 * RARE)))
    like = _like_family_names(rare.select("word"), words).select(F.lit("like").alias("role"), "word")
    return words.unionByName(cues).unionByName(like)


def _find_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for h, g, text, own, taken in zip(b["h"], b["g"], b["text"], b["names"], b["spans"], strict=True):
            words: dict[str, set] = {role: set() for role in (*ROLES, "like", "left", "right")}
            for pair in own if own is not None else ():
                role, _, word = pair.partition(":")
                words[role].add(word)
            words["every"] = words["given"] | words["sur"] | words["vn1"]
            spans = [(x["a"], x["z"], x["kind"]) for x in taken] if taken is not None else []
            spans = sorted(spans + find_names(text, spans, words))
            if not spans:
                continue
            seen: Counter = Counter()
            clean, last, kinds = [], 0, []
            for a, z, kind in spans:
                seen[kind] += 1
                kinds.append({"pii_type": kind, "occ": seen[kind], "start_pos": a, "end_pos": z})
                clean += [text[last:a], PLACEHOLDER[kind]]
                last = z
            rows.append((h, g, "".join([*clean, text[last:]]), kinds))
        yield pd.DataFrame(rows, columns=["h", "g", "clean_text", "found"])


def _names_of_texts(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """h, g, names: role:word of the words and pairs of words of each text (as name_runs makes them) that the lexicon holds."""
    apart = F.lit(r"(?:[^\p{L}\p{M}'’]|['’](?![\p{L}\p{M}])|(?<![\p{L}\p{M}])['’])+")
    folded = fold(F.trim(F.regexp_replace(F.col("text"), apart, F.lit(" "))))
    framed = texts.select("h", "g", F.split(F.concat(F.lit("^ ^ "), folded, F.lit(" $ $")), " ").alias("t"))
    beside = framed.select("h", "g", F.explode(F.arrays_zip(F.col("t").alias("a"), F.slice("t", 2, F.size("t")).alias("b"))).alias("p")).select("h", "g", "p.a", "p.b")
    cue = F.col("role").isin("left", "right")
    # a pair of words is looked up only behind a word that opens a cue
    opens = lexicon.where(cue).select(F.substring_index("word", " ", 1).alias("a")).distinct().select("a", F.lit("opens").alias("role"))
    met = beside.join(lexicon.where(~cue).select(F.col("word").alias("a"), "role").unionByName(opens), "a")
    pair = F.when(F.col("role") == "opens", F.concat("a", F.lit(" "), "b"))
    cues = lexicon.where(cue).select(F.col("word").alias("pair"), F.col("role").alias("side"))
    known = met.withColumn("pair", pair).join(cues, "pair", "left").where("role <> 'opens' or side is not null")
    name = F.when(F.col("role") == "opens", F.concat("side", F.lit(":"), "pair")).otherwise(F.concat("role", F.lit(":"), "a"))
    return known.groupBy("h", "g").agg(F.collect_set(name).alias("names"))


def redact(texts: DataFrame) -> DataFrame:
    """texts(src, row_key, text) -> src, row_key, clean_text, found array of (pii_type, occ, start_pos, end_pos).

    Every distinct text is read once. The lexicon reaches the texts by a join on their words.
    """
    keyed = texts.select("src", "row_key", "text", F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("g")).where("text is not null")
    once = cut(keyed.groupBy("h", "g").agg(F.any_value("text").alias("text"), F.count("*").alias("times")), "texts")
    told = cut(evidence(once), "told")
    lexicon = cut(name_words(told), "lexicon")
    spans = told.where("h is not null").select("h", "g", "spans")
    found = "array<struct<pii_type:string,occ:int,start_pos:int,end_pos:int>>"
    read = once.join(_names_of_texts(once, lexicon), ["h", "g"], "left").join(spans, ["h", "g"], "left").select("h", "g", "text", "names", "spans")
    read = read.mapInPandas(_find_batches, f"h long, g long, clean_text string, found {found}")
    rows = keyed.dropDuplicates(["src", "row_key", "h", "g"]).join(read, ["h", "g"], "left")
    return rows.select("src", "row_key", F.coalesce("clean_text", "text").alias("clean_text"), F.coalesce("found", F.expr(f"cast(array() as {found})")).alias("found"))
