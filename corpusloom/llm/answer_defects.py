"""Problem 4: broken prompt and response pairs.

Each answer is aligned with its question and with refusal templates, token by token:

* copies: every token of the answer comes from the question but for a few, shingles of the answer
  are contained in the question's, and the longest common subsequence covers one of the two;
* refusals: every sentence of the answer aligns (longest common subsequence over its length, words of
  one meaning united) with a template that declines or reports nothing found, or with a courtesy
  that may follow one. Templates are also learned: a sentence that answers at least TEMPLATE
  different questions and aligns loosely with a template is one;
* wrong language: script, else function words, name different languages with a clear margin;
* truncated: the answer stops without a close, on a dangling mark or function word, or inside a
  word (not in the corpus vocabulary, but the beginning of one that is). Which last words are such
  beginnings is worked out once per distinct last word by joins with the vocabulary's beginnings;
* empty: nothing but marks, white space, invisible characters or a filler.

A row has one defect; they are tried in the order empty, copy, refusal, language, truncation.

Defined results: a null answer is empty; a null question can be neither copied nor in another
language; null and empty modes allow a closing ``...`` like extractive ones; rows sent twice under
one id come out once; null ids are left out; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, with_lookup
from .scan_noise import vocabulary

DEFECTS = ("empty_answer", "truncated", "refusal", "copies_question", "wrong_language")

# Fillers that say nothing.
FILLERS = frozenset("none null n/a na nan nil undefined answer response reply result output tbd todo unknown empty blank no_answer".split())

# Sentences that decline or report that nothing was found.
REFUSALS = (
    "i'm sorry but i can't help with that request",
    "sorry i am unable to answer questions of this kind",
    "i won't be able to assist with this one",
    "i must decline to answer this",
    "i'd rather not answer that",
    "i cannot answer this question",
    "answering this is outside what i'm allowed to do",
    "it isn't possible for me to provide that",
    "that is not something i can discuss",
    "please ask the office concerned",
    "i don't have enough information to answer",
    "as an assistant i have no access to that information",
    "i could not find this in the indexed pages",
    "i could not find any information about this",
    "the passages do not say anything about this",
    "the documents do not contain this information",
    "there is nothing in my sources on this please contact the section directly",
    "no relevant passage was found so no answer can be given",
    "not available in the documents",
    "unfortunately the sources given contain no answer to your question",
    "my apologies this question falls beyond the pages i can read",
    "i do not know the answer",
    "désolé je ne peux pas répondre à cette question",
    "les pages consultées ne contiennent pas cette information",
    "je n'ai pas trouvé cette information",
    "leider kann ich diese frage nicht beantworten",
    "in den seiten steht dazu nichts",
    "dazu liegen mir keine informationen vor",
    "क्षमा करें मैं इस प्रश्न का उत्तर नहीं दे सकता",
    "इन पृष्ठों में इसके बारे में कुछ नहीं मिला",
    "मुझे इसकी जानकारी नहीं मिली",
    "i am not in a position to help with this matter",
    "this falls outside what i am able to assist with",
    "there is no information on that available to me",
    "the available material gives no answer to this question",
    "nothing relevant was found in the sources",
    "no answer is possible",
    "cannot answer",
    "cannot answer this",
    "the documents contain no information on this question",
    "je n'ai aucune information à ce sujet",
    "je ne suis pas en mesure de répondre",
    "ich habe dazu keine angaben gefunden",
    "darauf kann ich keine antwort geben",
    "इस बारे में मेरे पास कोई जानकारी नहीं है",
    "lo siento no puedo responder a esa pregunta",
    "no encontré información sobre esto en los documentos",
    "desculpe não posso responder a essa pergunta",
    "mi dispiace non posso rispondere a questa domanda",
)
# Words of one meaning in sentences that decline.
MEANINGS = {
    "cannot": "can't cannot couldn't unable won't can’t not don't doesn't didn't isn't wasn't no never nothing none nor",
    "answer": "answer help assist discuss respond provide reply comment",
    "question": "question request query enquiry inquiry matter topic subject one",
    "source": "sources source documents document passages passage pages page material files context",
    "find": "find found locate located see contain contains contained mention mentions say state",
    "sorry": "sorry apologies regret unfortunately afraid",
    "this": "this that these those it",
    "information": "information details data info anything",
}
COURTESIES = (
    "kindly rephrase your question",
    "please check the official site",
    "thank you for understanding",
    "is there anything else i can do",
    "please try again later",
)

# Function words by language.
LANGUAGE_WORDS = {
    "en": frozenset("the of and to in is are for on at by with from that this what which who when where how does do can could has have was were be it an my your and not".split()),
    "fr": frozenset("le la les des du de et en une un pour dans est sont avec sur au aux qui que quand où faut il ce cette nous ne pas par dès lors sous".split()),
    "es": frozenset("el los las del y en que por para con una es son se su al lo como más pero sus ya hay está cuando donde quién".split()),
    "pt": frozenset("o os da dos das em na nos nas que por para com uma é são não ao mais mas seu sua quando onde quem".split()),
    "it": frozenset("il lo gli di del della dei delle che con una è sono non si al alla più ma nel nella quando dove chi".split()),
    "nl": frozenset("het een van op te dat zijn voor met niet aan er maar om ook als bij naar wordt wanneer waar wie".split()),
    "de": frozenset("der die das den dem des und ist im in für mit von zu zum zur auf bis wo wann wer wie kann ich ein eine nicht werden am ab nach bei liegt".split()),
}
#: Languages that share many words with the others; three different words must name them.
FAR = ("es", "pt", "it", "nl")
SCRIPTS = (("hi", re.compile("[ऀ-ॿ]")), ("ru", re.compile("[Ѐ-ӿ]")), ("ar", re.compile("[؀-ۿ]")), ("zh", re.compile("[぀-ヿ一-鿿가-힯]")))
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_WORD = re.compile(r"[^\W_]+(?:['’ऀ-ःऺ-ॏ‍][^\W_]*)*")
_SENT = re.compile(r"(?<=[.!?।])\s+|\n+")
_DANGLING = frozenset(
    "the a an of and or to in is are for on at by with from that this which who when after before if so as than into under per rs no not be was were has have had will may must can then"
    " le la les des du de et en un une pour dans avec sur der die das den dem des und im für mit von zu bis का की के को में से और पर".split()
)


# Letters that point to a language.
MARKS = {"fr": frozenset("éèêàçôû"), "de": frozenset("äöüß"), "es": frozenset("ñ¿¡"), "pt": frozenset("ãõ")}


def language(text: str) -> str | None:
    latin = len(_LATIN.findall(text))
    if not text.isascii():
        for name, script in SCRIPTS:
            n = len(script.findall(text))
            if n > 3 and n > latin:
                return name
    if latin < 4:
        return None
    words = [w.lower() for w in _WORD.findall(text.replace("’", " "))]
    score = {k: float(sum(map(v.__contains__, words))) for k, v in LANGUAGE_WORDS.items()}
    marked = [w for w in words if not w.isascii()]
    for k, marks in MARKS.items() if marked else ():
        score[k] += 0.5 * sum(not marks.isdisjoint(w) for w in marked)
    (best, n), (_, m) = sorted(score.items(), key=lambda x: -x[1])[:2]
    if best in FAR and len(LANGUAGE_WORDS[best].intersection(words)) < 3:
        return None
    return best if n > 0 and n >= 2 * m and (n >= 2 or len(words) <= 6) else None


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one bit-parallel row (no table)."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & at.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def tokens(text: str) -> list[str]:
    return [w.lower().replace("’", "'") for w in _WORD.findall(text)]


_MEANS = {w: k for k, v in MEANINGS.items() for w in v.split()}


def meanings(words: list[str]) -> list[str]:
    return [_MEANS.get(w, w) for w in words]


_REFUSALS = [meanings(tokens(x)) for x in REFUSALS]
_COURTESIES = [meanings(tokens(x)) for x in COURTESIES]
_TEMPLATE_WORDS = frozenset(w for t in (*_REFUSALS, *_COURTESIES) for w in t)
_LONGEST = int(1.5 * max(map(len, _REFUSALS))) + 1
#: Different questions that a learned template answers; how closely it aligns with a fixed one.
TEMPLATE, LOOSELY = 5, 0.55


def _aligned(s: list[str], templates: list[list[str]], most: float = 0.75, least: float = 0.7) -> bool:
    known = _TEMPLATE_WORDS
    if sum(w in known for w in s) < least * len(s):  # no template can hold enough of it
        return False
    for t in templates:
        if len(s) <= 1.5 * len(t) + 1 and len(t) <= 1.5 * len(s) + 1:
            n = lcs(t, s)
            if n >= most * len(t) and n >= least * len(s):
                return True
    return False


def sentences(answer: str) -> list[list[str]]:
    return [x for x in map(tokens, _SENT.split(answer)) if x]


def template_keys(answer: str) -> set[str]:
    return {"t" + " ".join(s) for s in sentences(answer) if len(s) <= _LONGEST}


def is_refusal(answer: str, learned: dict[str, str] | None = None) -> bool:
    said = sentences(answer)
    if not said:
        return False

    def refuses(s: list[str]) -> bool:
        return len(s) <= _LONGEST and (_aligned(meanings(s), _REFUSALS) or bool(learned) and "t" + " ".join(s) in learned)

    declines = [refuses(s) for s in said]
    if not any(declines):
        return sum(map(len, said)) <= _LONGEST and refuses([w for s in said for w in s])
    return all(d or _aligned(meanings(s), _COURTESIES) for d, s in zip(declines, said))


def is_copy(question: str, answer: str) -> bool:
    q, a = tokens(question), tokens(answer)
    if len(q) < 2 or len(a) < max(2, 0.6 * len(q)) or len(a) > 6 * len(q) + 6:
        return False
    own = set(q)
    new = [w for w in a if w not in own]
    if len(new) > max(2, 0.2 * min(len(a), len(q))):
        return False
    shingles = set(zip(q, q[1:]))
    pairs = list(zip(a, a[1:]))
    held = sum(p in shingles for p in pairs) / len(pairs)
    return held >= 0.6 and lcs(q, a) >= 0.75 * min(len(q), len(a)) and lcs(q, a) >= 0.6 * len(q)


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    core = re.sub(r"[\W_]+", "", answer)
    return not core or re.sub(r"[^\w/]+", "", answer).lower() in FILLERS


_URL_END = re.compile(r"(?:https?://|www\.)\S+$")
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+")
_SHORT = re.compile(r"^(?:yes|no|\d|room|rs|on|[A-Z])", re.I)


class Truncation:
    """known: the corpus's answers ('p' + word: the word is the beginning of others and no word)."""

    def __init__(self, known: dict[str, str]):
        self.known = known

    def partial(self, word: str) -> bool:
        return "p" + word.lower() in self.known

    def inside_word(self, answer: str) -> bool:
        words = _WORD.findall(answer)
        return bool(words) and answer.rstrip().endswith(words[-1]) and self.partial(words[-1])

    def __call__(self, answer: str, mode: str | None) -> bool:
        a = answer.strip(" \t\r\n\u00a0​")
        llm = (mode or "").strip().lower().startswith("llm")
        if a.endswith(("...", "…")):
            core = a.rstrip(".… ")
            return core.endswith(("[", "(")) or llm and not core[-1:].isdigit()
        if a[-1:] in ".!?।\"”'’)]»":
            return False
        if a[-1:] in ",;:–—-([{&/":
            return True
        if _URL_END.search(a):
            return False
        last = a.rsplit("\n", 1)[-1]
        words = _WORD.findall(last)
        if not words:
            return False
        if words[-1].lower() in _DANGLING or self.partial(words[-1]) or last.count("(") > last.count(")"):
            return True
        if _ITEM.match(last):
            return len(words) < 2 or re.match(r"^\s*\d+[.)]\s+then$", last, re.I) is not None
        return len(words) > 6 or len(_WORD.findall(a)) > 12


def defect(question: str | None, answer: str | None, mode: str | None, cut: Truncation) -> str | None:
    if is_empty(answer):
        return "empty_answer"
    if question and is_copy(question, answer) and not cut.inside_word(answer):
        return "copies_question"
    if is_refusal(answer, cut.known):
        return "refusal"
    if question and (lq := language(question)) and (la := language(answer)) and lq != la:
        return "wrong_language"
    return "truncated" if cut(answer, mode) else None


def last_words(answer: str) -> set[str]:
    """Words that may have been broken off: the last of the answer and of its last line."""
    out = set()
    for part in (answer, answer.strip(" \t\r\n\u00a0​").rsplit("\n", 1)[-1]):
        if words := _WORD.findall(part[-200:] if len(part) > 200 and _WORD.search(part[-200:]) else part):
            out.add(words[-1].lower())
    return out


def _asked(answer: str) -> set[str]:
    return {"p" + w for w in last_words(answer)} | template_keys(answer)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = sorted({w for t in b.column("answer").to_pylist() for w in last_words(t)})
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["word"])


def _loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, q): sentences of an answer that align loosely with a template, and the question's hash."""
    memo: dict[str, bool] = {}
    for b in batches:
        rows = []
        for t, q in zip(b.column("answer").to_pylist(), b.column("q").to_pylist()):
            for k in template_keys(t):
                if (hit := memo.get(k)) is None:
                    if len(memo) > 100_000:
                        memo.clear()
                    hit = memo[k] = _aligned(meanings(k[1:].split(" ")), _REFUSALS, LOOSELY, LOOSELY)
                if hit:
                    rows.append((k, q))
        cols = list(zip(*rows)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], ["key", "q"])


def learned_keys(src: DataFrame) -> DataFrame:
    """(key, value): beginnings of words that end answers, and learned templates."""
    words = vocabulary(src.select(F.explode(F.array("question", F.regexp_replace("answer", r"\S+\s*$", ""))).alias("text")))
    answers = src.where("answer is not null")
    ends = answers.select("answer").mapInArrow(_ends, "word string").distinct().join(words.select("word"), "word", "left_anti")
    begin = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", F.lit(1), k))).alias("word"))
    partial = ends.join(begin.where("word <> ''"), "word", "left_semi").select(F.concat(F.lit("p"), "word").alias("key"))
    told = answers.select("answer", F.xxhash64(F.lower(F.coalesce("question", F.lit("")))).alias("q")).mapInArrow(_loose, "key string, q bigint")
    often = told.distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= TEMPLATE).select("key")
    return partial.unionByName(often).select("key", F.lit("").alias("value"))


def answer_defects(feedback: DataFrame) -> DataFrame:
    """(feedback_id, defect)."""
    src = feedback.select("feedback_id", "question", "answer", "mode").where("feedback_id is not null")
    rows, known = with_lookup(src, "answer", learned_keys(src), lambda t: _asked(t) if t else ())
    shared = feedback.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            ids, out = [], []
            for i, q, a, m, more in zip(*(d[c] for c in ("feedback_id", "question", "answer", "mode")), held(b)):
                if (x := defect(q, a, m, Truncation(more or shared.value))) is not None:
                    ids.append(i)
                    out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["feedback_id", "defect"])

    return rows.mapInArrow(run, "feedback_id bigint, defect string").groupBy("feedback_id").agg(F.min("defect").alias("defect"))
