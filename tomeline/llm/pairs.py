"""Broken prompt and response pairs: labelling functions combined by an expectation-maximisation label model.

For each defect several noisy functions vote yes (1), no (-1) or nothing (0) on a pair. Votes are counted by
pattern over all rows; EM fits for each defect its rate and how each function votes with and without it, so every
pattern gets a posterior. A pair keeps every defect whose posterior passes a cutoff validated on labelled pairs.

Whether an answer breaks off is judged against the whole corpus: how often the words it ends with end a sentence
elsewhere, and how often they go on.

Undefined cases: a null answer is empty; a null query leaves copied and other_language unvoted; pairs repeated under
one id count once; an empty table gives no pair.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeline.llm import language
from tomeline.session import cut

DEFECTS = ("empty", "copied", "refusal", "other_language", "truncated")
ORDERS = (7, 5, 4, 3, 2)
LATIN, LATIN_TOKEN = language.LATIN_TEXT, re.compile(r"[^\W\d_]+|\d+")
TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}]+|\p{N}+")
SEGMENT = regex.compile(r"(?<=[.!?…])[\"”’»)\]*]*\s+|(?<=[。！？।؟])[”’」』）*]*|\n+")
MARKUP = regex.compile(r"<[^<>]{0,40}>|```[a-z]*|[`*_#>|~]|\[\d{0,3}\]|​|﻿")
LEAD = regex.compile(r"^\W*(?:answer|response|question|q|a|you asked|your question|bạn hỏi|câu hỏi|trả lời|hỏi|frage|antwort|sie fragten|question posée|réponse|vous demandez|vous avez demandé|pregunta|respuesta|usted preguntó|usted pregunta|问|答|问题|回答|你问|您问|質問|ご質問)\s*[:：]", regex.I)

# Placeholders that stand for no answer.
PLACEHOLDERS = {"", "tbd", "todo", "n a", "na", "none", "null", "nil", "nan", "empty", "answer", "response", "placeholder", "undefined", "xxx", "tba", "leer", "vide", "trống", "vacío", "lorem ipsum"}
# Words that deny, words of knowing, telling and finding, and wordings that decline by themselves. A sentence
# declines if a word of the first kind and one of the second stand close together, or if it holds one of the last.
DENYING = (
    r"(?:\b(?:not|no|nothing|none|cannot|unable|nicht|nichts|kein\w*|ne|pas|aucune?s?|rien|no|nada|ningun[ao]?|ningún|không|chưa|chẳng|chả|не|нет|ничего)\b|n['’]t\b|\bn['’]|ไม่|नहीं|لا |لم |ليس )"
)
KNOWING = (
    r"(?:\b(?:know|known|knowledge|idea|clue|certain|sure|answer(?:s|ed|able)?(?!\W*:)|tell|say|help|assist\w*|comment|discuss|speak|provided?|find|found|information|info|evidence|mention\w*|cover\w*|contain\w*|context|sources?|results?|able|scope|guess|allowed"
    r"|weiß|wissen|bekannt|beantwort\w*|antwort\w*|sagen|helfen|auskunft|angaben?|information\w*|gefunden|finden|ahnung|raten|hinweis\w*"
    r"|sais|sait|savoir|répon\w*|dire|aider|trouv\w*|informations?|idée|connais\w*|parle|sé|sabe\w*|respond\w*|contest\w*|encontr\w*|información|decir|ayudar|habla"
    r"|biết|trả lời|tìm thấy|thông tin|nói về|đề cập|bàn (?:về|luận)|giúp|căn cứ|đoán|зна\w+|ответ\w*|информаци\w*|наш\w+|могу|сказать)\b|ทราบ|รู้|ตอบ|พบ|ข้อมูล|पता|उत्तर|जानकारी|मालूम|أعرف|أعلم|معلومات|أستطيع|إجاب)"
)
BETWEEN = r"(?:\W+\w+){0,5}?\W*"
DENIES = regex.compile(
    rf"{DENYING}{BETWEEN}{KNOWING}|{KNOWING}{BETWEEN}{DENYING}"
    r"|(?:不|没|沒|無|无|未)\p{Han}{0,3}(?:知道|清楚|回答|作答|了解|信息|資料|资料|找到|确定|猜|关于)|(?:わか|分か|知り|知ら|存じ|答え|回答|見つか)\p{Hiragana}{0,3}(?:ない|ません|なかった)|情報が足り|(?:모르|알|답|정보|찾)\p{Hangul}{0,3} ?(?:없|못|않)",
    regex.I,
)
DECLINING = regex.compile(
    r"\b(?:unanswerable|insufficient|unable to|must decline|(?:have|need|wish) to decline|i(?:['’]d)? (?:rather|prefer) not|beyond (?:me|my|the scope)|outside (?:of )?(?:my|the scope|what i)|don['’]?t know|no idea|need(?:ing)? more (?:context|information|details?)|ha(?:ve|s|d) nothing (?:for|on|about|to)|can['’]?t say|je l['’]ignore|j['’]ignore|hors de (?:mon|ma|mes)|m['’]abstenir|unbekannt|außerhalb meines?|fuera de mi|lo ignoro|ignoro|desconozco"
    r"|đành chịu|nằm ngoài|vượt quá khả năng)\b|^not_found\b|超出了|不足|できません|お答えでき|모르겠",
    regex.I,
)
# Words without marks one of which stands in every sentence in Latin letters that declines.
DENYING_WORDS = frozenset(
    "not no nothing none cannot unable t nicht nichts kein keine keinen keiner keinem keines ne n pas aucun aucune aucuns aucunes rien nada ninguna ninguno ningun khong chua chang cha unanswerable insufficient decline prefer rather beyond outside know idea say need needing ignore abstenir hors unbekannt ausserhalb auserhalb fuera ignoro desconozco danh nam vuot".split()
)
TURN = regex.compile(r"\b(?:but|however|yet|nhưng|aber|jedoch|mais|pero)\b|但|しかし", regex.I)
SHORT_LEAD = regex.compile(r"^(?:in short|tóm lại|kurz gesagt|en bref|en resumen|answer)\s*[:：]\s*|^(?:简单来说，|要するに、)", regex.I)
OPEN_END = regex.compile(r"(?:[,，、:：;；(\[（「『“«‘—–]|\s-|\b-)\s*$")
DOTS_END = regex.compile(r"(?:…|\.\.\.)\s*$")
STOP_END = regex.compile(r"(?:[.!?。！？।؟✔✓](?<!\.\.\.)|\|)[\"”’»)\]）」』*`\s]*$|```\s*$|\[[^\[\]]*\]\s*$|\([^()]*\)\s*$")
NUMBERS = regex.compile(r"\p{N}+")
VISIBLE, NUMBER, EMPHASIS = regex.compile(r"[\p{L}\p{N}]"), regex.compile(r"\p{N}"), regex.compile(r"[*_`>#]")
FENCED, BOLD_END = regex.compile(r"```.*?```", regex.S), regex.compile(r"\*\*\s*$")
ITEM_END = regex.compile(r"\n\s*(?:\p{N}{1,2}[.)]|[-*•])[\s*]*$")
VALUE = regex.compile(r"^\W*\p{N}[\p{N}.,]*\s*\W*\p{L}{0,4}\W*$")

# Labelled pairs on which the cutoffs are validated: (query, answer, defect or "").
VALIDATION = (
    ("Where is the boat shed?", "", "empty"), ("Where is the boat shed?", "n/a", "empty"), ("Where is the boat shed?", "<div></div>", "empty"), ("Where is the boat shed?", "- \n", "empty"),
    ("How old is the mill?", "How old is the mill?", "copied"), ("How old is the mill?", "> how old is the mill", "copied"), ("How old is the mill?", "You asked: How old is the mill?", "copied"),
    ("Wie alt ist die Mühle?", "„Wie alt ist die Mühle?“", "copied"), ("How old is the mill?", "I don't know.", "refusal"), ("How old is the mill?", "In short: I'm unable to answer that.", "refusal"),
    ("Cối xay bao nhiêu tuổi?", "Tôi không biết.", "refusal"), ("Quel âge a le moulin ?", "Désolé, je ne peux pas répondre.", "refusal"), ("How old is the mill?", "The mill is about 90 years old.", ""),
    ("How old is the mill?", "90", ""), ("How old is the mill?", "75.", ""), ("How old is the mill?", "No idea, sorry.", "refusal"), ("How old is the mill?", "The sources provide no information on this.", "refusal"),
    ("Wie alt ist die Mühle?", "Dazu ist mir nichts bekannt.", "refusal"), ("¿Cuántos años tiene el molino?", "No encuentro esa información.", "refusal"), ("Cối xay bao nhiêu tuổi?", "Tôi chưa tìm thấy thông tin nào.", "refusal"), ("磨坊多少年了？", "我不知道。", "refusal"),
    ("How old is the mill?", "The first sign does not say, but the second one does: ninety years.", ""), ("How old is the mill?", "Nobody lives there now. The mill is not far from the river.", ""), ("How old is the mill?", "The mill is old:\n1. It stands by the river.\n2.", "truncated"), ("How old is the mill?", "≈ 90 kg", ""), ("How old is the mill?", "Sorry for the wait. The mill is 90 years old.", ""),
    ("How old is the mill?", "Die Mühle ist ungefähr neunzig Jahre alt und steht am Fluss.", "other_language"), ("How old is the mill?", "La ferme est ouverte tous les jours et le moulin est fermé.", "other_language"),
    ("Wie alt ist die Mühle?", "The mill is about ninety years old and stands by the river.", "other_language"), ("Cối xay bao nhiêu tuổi?", "この水車は九十年前に作られました。", "other_language"),
    ("How old is the mill?", "The mill (“die Mühle”) is about ninety years old.", ""), ("How old is the mill?", "The mill is about ninety years old and stands by the,", "truncated"),
    ("How old is the mill?", "The mill is about ninety years old. It stands by the river and (", "truncated"), ("How old is the mill?", "The mill is old.\n```yaml\nage: 9", "truncated"), ("How old is the mill?", "The mill is **about ninety", "truncated"),
    ("How old is the mill?", "The mill is about ninety years old. ✔", ""), ("Wie alt ist die Mühle?", "Die Mühle ist ungefähr neunzig Jahre alt.", ""), ("Cối xay bao nhiêu tuổi?", "Coi xay da chin muoi tuoi.", ""),
)


def _tokens(text: str) -> list[str]:
    return LATIN_TOKEN.findall(text) if LATIN.match(text) else TOKEN.findall(text)


def _plain(text: str) -> str:
    return " ".join(map(language.fold_word, _tokens(MARKUP.sub(" ", text))))


def _words(text: str) -> list[str]:
    return ["9" if t[0].isnumeric() else t for t in _tokens(text.lower())]


@lru_cache(maxsize=200_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _grams(hashes: list[int]) -> list[int]:
    """Hashes of the last 7, 5, 4, 3, 2 and 1 of the words."""
    out, h = [], 1469598103934665603
    for n, w in enumerate(reversed(hashes[-7:]), 1):
        h = (h * 1099511628211 + w) & 0xFFFFFFFFFFFFFFFF
        if n != 6:
            out.append(h - (1 << 63))
    while len(out) < 6:
        out.append(out[-1])
    return out[::-1]


def _without_leads(text: str) -> str:
    text = text.strip(" \n\t\"'“”„«»‘’*>")
    while m := (LEAD.match(text) or SHORT_LEAD.match(text)):
        text = text[m.end() :].strip(" \n\t\"'“”„«»‘’*>")
    return text


def _own_words(query: str, asked: str, said: str) -> tuple[int, int]:
    """Tokens of the answer (plain), and those left when whole repeats of the query or of its sentences are taken out."""
    left = f" {said} "
    n = len(left.split())
    parts = SEGMENT.split(query)
    for part in sorted({asked, *(map(_plain, parts) if len(parts) > 1 else ())}, key=len, reverse=True):
        if len(part) > 3:
            while f" {part} " in left:
                left = left.replace(f" {part} ", " ")
    return n, len(left.split())


class Weights:
    """What the labelling functions learn: letter groups by language, and runs of words by how they go with the flag."""

    def __init__(self, languages: language.Weights, flagged: dict[str, float] | None = None) -> None:
        self.languages, self.flagged = languages, flagged or {}
        self.known: dict[str, float] = {}

    def __reduce__(self):
        return Weights, (self.languages, self.flagged)

    def score(self, sentence: str) -> float:
        """Mean log odds of the runs of words of a sentence for a flagged answer; 0 where nothing was learned."""
        got = self.known.get(sentence)
        if got is None:
            if len(self.known) > 50_000:
                self.known.clear()
            found = [self.flagged[f] for f in _flag_features(sentence) if f in self.flagged]
            got = self.known[sentence] = sum(found) / len(found) if found else 0.0
        return got


FLAG_ROWS = 10_000  # at most so many flagged and so many other answers are fitted on
LEAST_SEEN = 3  # answers that must hold a run of words before it says anything


def _flag_features(text: str) -> set[str]:
    """The runs of two and three words of a text, numbers alike."""
    out = set()
    for line in _sentences(text):
        words = ["^", *(language.fold_word(w) for w in _words(line)), "$"]
        out.update(" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1))
    return out


def fit_flag(answers: list[tuple[str, bool]]) -> dict[str, float]:
    """Log odds of runs of words for answers with the flag, both sides weighted alike; empty without both sides."""
    counts = (Counter(), Counter())
    for answer, flag in answers:
        counts[flag].update(_flag_features(answer))
    total = [sum(f == flag for _, f in answers) for flag in (False, True)]
    if not all(total):
        return {}
    often = [f for f in counts[0].keys() | counts[1].keys() if counts[0][f] + counts[1][f] >= LEAST_SEEN]
    return {f: math.log((counts[1][f] + 0.5) / total[1] / ((counts[0][f] + 0.5) / total[0])) for f in often}


def fit(pairs: DataFrame, documents: DataFrame) -> Weights:
    """Fits on at most language.FIT_ROWS documents a language and FLAG_ROWS answers with and without the flag."""
    flagged = pairs.select("not_found", "answer", F.xxhash64("answer").alias("h")).where("not_found is not null and answer is not null").distinct()
    some = flagged.withColumn("r", F.row_number().over(Window.partitionBy("not_found").orderBy("h"))).where(F.col("r") <= FLAG_ROWS)
    return Weights(language.fit(documents), fit_flag([(r["answer"], r["not_found"]) for r in some.select("answer", "not_found").toLocalIterator()]))


def _sentences(text: str) -> list[str]:
    return [s for s in (p.strip() for p in SEGMENT.split(text)) if s]


def votes(query: str | None, answer: str | None, not_found: bool | None, weights: Weights) -> dict[str, tuple[int, ...]]:
    """The votes of all functions but those that need the corpus."""
    text = answer or ""
    plain = _plain(text)
    nothing = not VISIBLE.search(MARKUP.sub("", text))
    filler = plain in PLACEHOLDERS
    brief = len(plain) <= 12 and not NUMBER.search(plain) and not STOP_END.search(text)
    out = {"empty": (1 if nothing else 0 if filler else -1, 1 if nothing or filler else -1, 1 if nothing or filler or brief else -1)}
    if query and not nothing and (plain_query := _plain(query)):
        bare = _without_leads(text)
        plain_said = plain if bare == text else _plain(bare)
        n, own = _own_words(query, plain_query, plain_said)
        asked = set(plain_query.split())
        said = plain_said.split()
        inside = sum(w in asked for w in said) / max(1, len(said))
        out["copied"] = (1 if own == 0 else -1, 1 if own <= 0.1 * n else -1, 1 if inside >= 0.95 and len(said) >= 0.6 * len(asked) and own < 0.5 * n else -1)
    else:
        out["copied"] = (0, 0, 0)
    calm = EMPHASIS.sub(" ", text) if not text.strip().upper().startswith("NOT_FOUND") else text
    parts = [SHORT_LEAD.sub("", s) for s in _sentences(calm)]
    parts = [s for s in parts if VISIBLE.search(s)]
    open_to_doubt = not LATIN.match(text) or not DENYING_WORDS.isdisjoint(plain.split())
    worded = [open_to_doubt and bool(DECLINING.search(s) or (m := DENIES.search(s)) and not TURN.search(s, m.end())) for s in parts]
    scores = [weights.score(s) for s in parts]
    flag = 0 if not_found is None else 1 if not_found else -1
    if parts:
        strong = [x >= 1.0 for x in scores]
        out["refusal"] = (
            1 if sum(worded) * 2 >= len(parts) else 0 if any(worded[:2]) or len(parts) <= 2 and not NUMBER.search(text) else -1,
            (1 if any(strong) and len(parts) <= 4 else -1) if any(scores) else 0,
            flag,
            -1 if len(parts) > 4 or NUMBER.search(text) else 1 if any(w and x >= 0 for w, x in zip(worded, scores, strict=True)) else 0,
        )
    else:
        out["refusal"] = (0, 0, flag, 0)
    asked_in = language.detect(query, weights.languages) if query else (None, 0.0)
    said_in = language.detect(text, weights.languages)
    if asked_in[0] and said_in[0]:
        differs = asked_in[0] != said_in[0]
        sure = 1 if said_in[0] not in language.LATIN or asked_in[0] not in language.LATIN else said_in[1] > 0.25 and asked_in[1] > 0.1
        # where the whole answer is in the language of the query, so are most of its sentences
        each = [d for s in _sentences(text) if len(s) > 8 and (d := language.detect(s, weights.languages)[0])] if differs else [asked_in[0]]
        other = sum(d != asked_in[0] for d in each) / len(each) if each else 0.0
        out["other_language"] = ((1 if sure else 0) if differs else -1, (1 if other > 0.5 else -1) if each else 0, 1 if differs and sum(c.isalpha() for c in text) > 12 else -1)
    else:
        out["other_language"] = (0, 0, 0)
    tail = text.rstrip()
    fences = tail.count("```") % 2 == 1
    flat = FENCED.sub("", tail)
    unclosed = fences or flat.count("**") % 2 == 1 or any(flat.count(a) > flat.count(b) for a, b in (("(", ")"), ("[", "]"), ("“", "”"), ("（", "）"), ("「", "」"), ("«", "»")) if not ("„" in flat and a == "“"))
    dangling = fences or bool(BOLD_END.search(tail) and flat.count("**") % 2 == 1) or bool(ITEM_END.search(tail))
    ends = bool(STOP_END.search(tail)) and not DOTS_END.search(tail) and not dangling
    out["truncated"] = (1 if dangling or OPEN_END.search(tail) else -1 if ends else 0, 1 if unclosed else -1 if ends else 0, 1 if DOTS_END.search(tail) else -1 if ends else 0)
    return out


def ending(answer: str | None) -> list[int] | None:
    """Hashes of the last words of an answer that shows no stop (7, 5, 4, 3, 2, 1 of them); None if it ends well."""
    if not answer or not answer.strip():
        return None
    text = answer.rstrip()
    if STOP_END.search(text) and not DOTS_END.search(text):
        return None
    lines = _sentences(DOTS_END.sub("", text).rstrip())
    words = _words(lines[-1]) if lines else []
    if len(words) < 2 or VALUE.match(lines[-1]):
        return None
    return _grams([_word_hash("^"), *map(_word_hash, words)])


def _vote_batches(weights: Weights):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [votes(q, a, None if pd.isna(f) else bool(f), weights) for q, a, f in zip(b["query"], b["answer"], b["not_found"], strict=True)]
            out = b[["src", "row_id"]].copy()
            for d in DEFECTS:
                out[d] = [",".join(map(str, v[d])) for v in found]
            out["tail"] = [ending(a) for a in b["answer"]]
            yield out

    return run


def _gram_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each run of words ends a sentence and how often it goes on, summed within the task.

    Sentences alike but for their numbers are counted first and taken apart once.
    """
    whole: Counter = Counter()
    broken: Counter = Counter()

    def flush() -> pd.DataFrame:
        ends: Counter = Counter()
        goes: Counter = Counter()
        start = _word_hash("^")
        for lines, closed in ((whole, True), (broken, False)):
            for line, times in lines.items():
                words = [start, *map(_word_hash, _words(line))]
                last = len(words)
                for j in range(2, last + 1):
                    if j == last and not closed:
                        break
                    to = ends if j == last else goes
                    for g in dict.fromkeys(_grams(words[max(0, j - 7) : j])):
                        to[g] += times
            lines.clear()
        keys = list(ends.keys() | goes.keys())
        return pd.DataFrame({"gram": keys, "ends": [ends[k] for k in keys], "goes": [goes[k] for k in keys]})

    for b in batches:
        for answer in b["answer"].dropna():
            lines = [NUMBERS.sub("9", line) for line in _sentences(answer.lower())]
            if lines and ending(answer) is not None:
                broken[lines.pop()] += 1
            whole.update(lines)
        if len(whole) + len(broken) > 60_000:
            yield flush()
    yield flush()


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Posterior of the defect for each vote pattern, by EM over the pattern counts.

    The functions are taken as independent given the defect; a function that gives no vote says nothing; posteriors
    start from the majority.
    """
    if not patterns:
        return {}
    m = len(patterns[0][0])
    post = {p: 0.97 if sum(p) > 0 else 0.5 if sum(p) == 0 and any(p) else 0.02 for p, _ in patterns}
    for _ in range(rounds):
        total = sum(c for _, c in patterns)
        yes = sum(post[p] * c for p, c in patterns)
        rate = (yes + 1) / (total + 20)
        like = {}
        for i in range(m):
            for y in (0, 1):
                weight = {-1: 1.0 if y else 4.0, 1: 4.0 if y else 1.0}  # a function is better than chance
                for p, c in patterns:
                    if p[i]:
                        weight[p[i]] += c * (post[p] if y else 1 - post[p])
                s = sum(weight.values())
                for v in weight:
                    like[i, v, y] = weight[v] / s
        for p, _ in patterns:
            a = math.log(rate) + sum(math.log(like[i, p[i], 1]) for i in range(m) if p[i])
            b = math.log(1 - rate) + sum(math.log(like[i, p[i], 0]) for i in range(m) if p[i])
            post[p] = 1 / (1 + math.exp(min(50, max(-50, b - a))))
    return post


def _cutoff(scored: list[tuple[float, bool]]) -> float:
    """The cutoff of best F1 on the labelled pairs, nearest 0.5 among equals."""
    def f1(c: float) -> float:
        hit = sum(y for s, y in scored if s >= c)
        return 2 * hit / max(1, sum(s >= c for s, _ in scored) + sum(y for _, y in scored))

    return max((x / 20 for x in range(2, 19)), key=lambda c: (round(f1(c), 6), -abs(c - 0.5)))


def find_defects(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """pairs(src, row_id, query, answer, not_found), documents(text, lang) -> src, row_id, defects array<string>.

    defects lists every defect whose posterior passes its cutoff, in the order of DEFECTS; pairs without one are left out.
    """
    spark: SparkSession = pairs.sparkSession
    weights = fit(pairs, documents)
    labelled = spark.createDataFrame([("#", i, q, a, None) for i, (q, a, _) in enumerate(VALIDATION)], "src string, row_id long, query string, answer string, not_found boolean")
    rows = pairs.select("src", F.col("row_id").cast("long").alias("row_id"), "query", "answer", "not_found")
    schema = "src string, row_id long, " + ", ".join(f"{d} string" for d in DEFECTS) + ", tail array<long>"
    voted = cut(rows.unionByName(labelled).mapInPandas(_vote_batches(weights), schema), "votes")
    tails = voted.where("tail is not null").select("src", "row_id", F.posexplode("tail").alias("at", "gram")).distinct()
    wanted = tails.select("gram").distinct()
    counted = rows.select("answer").mapInPandas(_gram_batches, "gram long, ends long, goes long")
    grams = counted.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    known = tails.join(grams, "gram", "left").withColumn("n", F.coalesce(F.col("ends") + F.col("goes"), F.lit(0)))
    last = len(ORDERS)
    judged = known.groupBy("src", "row_id").agg(
        F.min_by(F.struct("ends", "n"), F.when((F.col("n") >= 3) & (F.col("at") < last), F.col("at"))).alias("best"),
        F.max(F.when(F.col("at") == last, F.col("n"))).alias("word"),
    )
    share = F.col("best.ends") / F.col("best.n")
    ends_vote = F.when(F.col("best").isNull(), 1).when(share < 0.1, 1).when(share > 0.4, -1).otherwise(0)
    word_vote = F.when(F.col("word") == 0, 1).otherwise(0)
    all_votes = voted.drop("tail").join(judged.select("src", "row_id", ends_vote.alias("e"), word_vote.alias("w")), ["src", "row_id"], "left")
    open_votes = F.concat_ws(",", "truncated", F.coalesce("e", F.lit(-1)), F.coalesce("w", F.lit(-1)))
    all_votes = cut(all_votes.withColumn("truncated", F.when(F.col("truncated") == "0,0,0", F.concat_ws(",", "truncated", F.coalesce("e", F.lit(0)), F.coalesce("w", F.lit(0)))).otherwise(open_votes)).drop("e", "w"), "patterns")
    checked = [r for r in all_votes.where("src = '#'").collect()]  # the labelled pairs
    result = all_votes.where("src <> '#'")
    flags = []
    for d in DEFECTS:
        counts = result.groupBy(d).count().collect()  # at most 3 ** 5 patterns
        seen = {tuple(map(int, r[d].split(","))): r["count"] for r in counts}
        for r in checked:
            seen.setdefault(tuple(map(int, r[d].split(","))), 0)
        post = fit_label_model(list(seen.items()))
        truth = {i: lab for i, (_, _, lab) in enumerate(VALIDATION)}
        limit = _cutoff([(post[tuple(map(int, r[d].split(",")))], truth[r["row_id"]] == d) for r in checked])
        passing = [",".join(map(str, p)) for p, s in post.items() if s >= limit]
        flags.append(F.when(F.col(d).isin(passing), F.lit(d)))
    return result.select("src", "row_id", F.array_compact(F.array(*flags)).alias("defects")).where(F.size("defects") > 0).distinct()
