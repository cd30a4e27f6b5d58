"""Broken prompt and response pairs: empty, copied, refused, in another language or cut off.

Prompt and response are aligned by shingle containment and by their longest common subsequence to find copies, and the
response's sentences are aligned with refusal templates. Its language is told by letter models and compared with the
prompt's. Responses that break off are found by their own surface and by the corpus: a response's wording, with numbers and names taken from the prompt masked, is cut off if most responses
that begin with the same words go on.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.languages import MOST_PER_WORD, LanguageModel, model_of, script_of, stop_words
from ledgerloom.operators.bounded import lookup_join
from ledgerloom.session import ship_package, written

#: Labels that stand before the parts of a response; the first group introduces the answer itself.
ANSWER_LABELS = ("answer", "a", "response", "reply", "antwort", "réponse", "respuesta", "risposta")
OTHER_LABELS = ("source", "sources", "quote", "quotes", "reference", "citation")
#: Words that only hold a place.
PLACEHOLDERS = {"", "na", "none", "null", "nil", "nan", "tbd", "tbc", "todo", "undefined", "empty", "blank", "noanswer", "answer", "youranswerhere", "yourresponse", "insertanswer", "placeholder", "loremipsum"}
#: Openings under which a prompt is repeated.
REPEATS = ("you asked", "your question", "question", "q", "the question is", "the question was")
#: Classes of words in refusals.
REFUSAL_WORDS = {
    "self": "i we assistant ai chatbot",
    "own": "my our",
    "me": "me us",
    "not": "not cannot unable never unwilling",
    "no": "no",
    "speak": "help assist answer provide give share disclose reveal discuss comment state say tell advise respond reply comply quote fulfil fulfill offer speak confirm talk release handle engage address helping assisting answering providing giving sharing disclosing revealing discussing commenting stating saying telling advising responding replying quoting offering speaking confirming talking releasing handling addressing",
    "spoken": "disclosed revealed shared discussed answered provided given released stated",
    "word": "comment answer response reply help assistance advice statement",
    "decline": "decline refuse refrain abstain pass withhold declining refusing",
    "past": "beyond outside",
    "against": "against violate violates contrary breach breaches",
    "rules": "instructions guidelines guideline policy policies rules programming remit mandate",
    "stop": "prevent prevents forbid forbids prohibit prohibits restrict restricts bar bars stop stops",
    "replies": "answers replies responses help assistance advice role",
    "limited": "limited restricted confined",
    "wrong": "inappropriate improper unethical",
    "something": "something anything",
    "have": "have",
    "access": "access permission authority authorisation authorization clearance",
    "be": "be",
    "secret": "confidential classified secret",
}
#: Refusals as classes of words in order, each with the words that may stand before the next; ^ is the sentence's beginning.
REFUSALS = (
    "self 4 not 4 speak", "^ 2 not 4 speak", "self 4 decline", "^ 1 decline", "^ 0 no 0 word",
    "not 1 something 2 self 4 speak", "speak 12 not 1 something 2 self", "not 1 something 2 self",
    "past 3 self 3 speak", "past 1 own 2 rules", "against 2 own 2 rules", "own 2 rules 3 stop", "own 2 rules 2 not 3 me", "own 1 replies 3 limited",
    "wrong 4 me 3 speak", "self 3 not 1 have 4 access", "not 0 be 2 spoken", "^ 6 secret",
)
#: Refusals in other languages; * stands for any words.
FOREIGN_REFUSALS = (
    "das kann ich leider nicht beantworten", "dazu darf ich * keine auskunft geben", "ich kann * nicht beantworten", "ich kann dabei nicht helfen",
    "je ne peux pas répondre à *", "je ne suis pas autorisé à *", "je ne peux pas vous aider",
    "no puedo responder a *", "lo siento, no puedo ayudar con eso", "no estoy autorizado a *",
    "non posso rispondere a *", "mi dispiace, non posso aiutare", "não posso responder a *", "não posso ajudar com isso", "daar kan ik geen antwoord op geven", "ik kan * niet beantwoorden",
)
#: Words after which no answer ends.
OPEN_ENDS = frozenset("the a an of and or but by for to in on at with from per until than as is are was were be been if that which its their not no more most into under over after before because since while each any every these those this first second both will may can must shall would should GBP".lower().split()) - {"no", "not", "first", "second", "more", "most", "both", "can", "may", "this", "that", "is", "any"}

_TOKEN = re.compile(r"[^\W_]+(?:['’.,:/-][^\W_]+)*")
_NAME = re.compile(r"\b[A-Z][\w'-]*")
_NUMBER = re.compile(r"\d+(?:[.,:/-]\d+)*")
_LABEL = re.compile(r"(?im)(?:^|(?<=\s))[*_#>\s]*(%s)\s*:[*_]*" % "|".join([*ANSWER_LABELS, *OTHER_LABELS]))


def tokens_of(s: str) -> list[str]:
    return _TOKEN.findall(s.lower())


_ODD = re.compile(r"[^\x20-\x7e\n\r\t]")


def plain(s: str) -> str:
    """The text in composed form, without characters that show nothing."""
    if not _ODD.search(s):
        return s
    return "".join(c for c in unicodedata.normalize("NFKC", s) if c in "\n\r\t" or unicodedata.category(c) not in ("Cf", "Cc", "Co", "Cn"))


def answer_part(answer: str) -> str:
    """What is said under the answer label, or all before other labels if there is none."""
    if ":" not in answer:
        return answer.strip()
    marks = [(m.start(), m.end(), m.group(1).lower()) for m in _LABEL.finditer(answer)]
    marks = [m for m in marks if m[2] not in ("a",) or answer[: m[0]].strip() == ""]
    parts = []
    if not marks or answer[: marks[0][0]].strip():
        parts.append(answer[: marks[0][0]] if marks else answer)
    for k, (_, end, label) in enumerate(marks):
        if label in ANSWER_LABELS:
            parts.append(answer[end : marks[k + 1][0] if k + 1 < len(marks) else len(answer)])
    return "\n".join(parts).strip()


_LONGEST = max(map(len, PLACEHOLDERS)) + 1


def is_empty(part: str) -> bool:
    bare = "".join(islice((c for c in part if c.isalnum()), _LONGEST)).lower()
    return bare in PLACEHOLDERS


def common_length(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, by the bits of one whole number per text."""
    places: dict[str, int] = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    full = v = (1 << len(b)) - 1
    for x in a:
        u = v & places.get(x, 0)
        if u:
            v = (v + u | v - u) & full
    return len(b) - v.bit_count()


def shingles(t: list[str], k: int = 3) -> set[tuple[str, ...]]:
    return {tuple(t[i : i + k]) for i in range(len(t) - k + 1)} or ({tuple(t)} if t else set())


def without_prompt(prompt: list[str], answer: str, words: list[str] | None = None) -> str:
    """The answer (its words, if they are known already) without a repetition of the prompt at its head."""
    rest = answer
    # Of the first tenth and one more of the prompt's words one must stand near the head, else no repetition is near enough.
    k = len(prompt) // 10 + 1
    while len(prompt) >= 3:
        head = words[: 2 * k + 5] if words is not None else [m.group().lower() for m in islice(_TOKEN.finditer(rest), 2 * k + 5)]
        if not set(head).intersection(prompt[:k]):
            return rest
        words = None
        found = list(islice(_TOKEN.finditer(rest), len(prompt) + 4))
        t = [m.group().lower() for m in found]
        if len(t) < len(prompt):
            return rest
        skip = next((len(r) for r in sorted((r.split() for r in REPEATS), key=len, reverse=True) if t[: len(r)] == r and t[len(r) : len(r) + 2] == prompt[:2]), 0)
        head = t[skip : skip + len(prompt)]
        if len(head) < len(prompt) or common_length(head, prompt) < 0.9 * len(prompt):
            return rest
        rest = rest[found[skip + len(prompt) - 1].end() :].lstrip("?.!\"'”’»: \n\r\t")
        if not rest:
            return ""
    return rest


def is_copy(prompt: list[str], a: list[str], rest: list[str]) -> bool:
    """Whether the answer's words a give back the prompt and nothing else; rest is what follows a repetition at its head."""
    if len(prompt) < 3 or len(a) < 3:
        return False
    if len(rest) < len(a):  # a repetition at the head: what follows it is the answer, if anything but the prompt again
        return not rest or (len(rest) >= 0.5 * len(prompt) and common_length(rest, prompt) >= 0.9 * len(rest))
    if len(a) * 0.85 > len(prompt) or len(prompt) * 0.7 > len(a):
        return False  # no subsequence is long enough for both
    c = common_length(a, prompt)
    if c < 0.85 * len(a) or c < 0.7 * len(prompt):
        return False
    inside = shingles(a)
    return len(inside & shingles(prompt)) >= 0.6 * len(inside)


_CLASSES: dict[str, frozenset[str]] = {k: frozenset(w.split()) for k, w in REFUSAL_WORDS.items()}
#: Of each template its classes (None: the beginning) and how many words may stand before the next.
_TEMPLATES = tuple((tuple(None if c == "^" else _CLASSES[c] for c in t.split()[::2]), tuple(map(int, t.split()[1::2]))) for t in REFUSALS)
#: Every template has a word of one of these.
_CUES = frozenset().union(*(_CLASSES[c] for c in ("not", "decline", "word", "past", "against", "stop", "limited", "wrong", "secret")))
#: Of each foreign refusal the words and how many must be met.
_FOREIGN = tuple((tokens_of(t.replace("*", " ")), 8 if "*" in t else 0) for t in FOREIGN_REFUSALS)
_FOREIGN_WORDS = frozenset(w for t, _ in _FOREIGN for w in t[:3])
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|[\r\n]+")
_FULL = ((re.compile(r"\bcan(?:'t| not)\b"), "cannot"), (re.compile(r"\bwon't\b"), "will not"), (re.compile(r"n't\b"), " not"), (re.compile(r"\b(i|we)'(?:m|re|d|ll|ve)\b"), r"\1"))


def aligned(words: list[str], classes: tuple, gaps: tuple[int, ...]) -> bool:
    """Whether the words follow a template: one of each class in order, with no more words between two than its gap."""
    at = [-1] if classes[0] is None else [i for i, w in enumerate(words) if w in classes[0]]
    for c, gap in zip(classes[1:], gaps):
        at = sorted({j for i in at for j in range(i + 1, min(len(words), i + gap + 2)) if words[j] in c})
        if not at:
            return False
    return bool(at)


def declines(sentence: str) -> bool:
    """Whether a sentence (lower case) follows a refusal template."""
    own = set(_TOKEN.findall(sentence))
    if not own.isdisjoint(_CUES) or "n't" in sentence or "can not" in sentence:
        for pattern, full in _FULL:
            sentence = pattern.sub(full, sentence)
        words = _TOKEN.findall(sentence)
        if any(aligned(words, *t) for t in _TEMPLATES):
            return True
    if len(own & _FOREIGN_WORDS) >= 2:
        words = tokens_of(sentence)
        return any(len(words) <= len(t) + 2 + gap and common_length(words, t) >= 0.9 * len(t) for t, gap in _FOREIGN)
    return False


def is_refusal(part: str, prompt: list[str]) -> bool:
    """Whether the answer declines: one of its sentences does, and none before or after tells anything.

    A sentence tells something if it has a number that the prompt hasn't or answers yes or no. Answers of any length are
    read whole, sentence by sentence.
    """
    text = part.lower()
    text = text.replace("’", "'") if "’" in text else text
    if _ANY_CUE.search(text) is None:
        return False
    refused = False
    asked = set(prompt)
    for s in _SENTENCE.split(text):
        if s[:4] in ("yes,", "yes ", "yes.", "yes:") or s == "yes":
            return False
        refused = refused or declines(s)
        if any(c.isdigit() for c in s) and any(n not in asked for n in _NUMBER.findall(s)):
            return False
    return refused


_ANY_CUE = re.compile(r"n't\b|\bcan not\b|\b(?:" + "|".join(sorted(_CUES | _FOREIGN_WORDS)) + r")\b")


def _spoken(words: list[str], names: set[str]) -> list[str]:
    """The different words that are neither names nor numbers."""
    return [w for w in dict.fromkeys(words) if w not in names and w[0] > "9" and (w.isalpha() or not any(c.isdigit() for c in w))]


def other_language(prompt: str, p: list[str], names: set[str], answer: str, a: list[str], model: LanguageModel) -> bool:
    """Whether the answer (words a) is in another language than the prompt (words p); names of the prompt and numbers don't count.

    By script, or by the letter models if both are in Latin letters: a language for each must be more probable than the
    best one for both by more than one word alone can say.
    """
    script, asked = script_of(answer), script_of(prompt)
    if script or asked:
        return bool(script != asked and p and (script or len(_spoken(a, names)) > 2))
    own = _spoken(a, names)
    if len(own) < 2 or not p:
        return False
    said = model.scores(own)
    best = said.max()
    if best - said.min() <= MOST_PER_WORD:
        return False
    mine = model.prompt_scores(tuple(_spoken(p, names)))
    return bool(best - (said + mine).max() > MOST_PER_WORD)


def wording(names: set[str], answer: str) -> list[str]:
    """The answer's words with numbers as # and names of the prompt as §, for comparison with other answers."""
    out: list[str] = []
    for w in answer.split():
        if w.isalpha() and w not in names:
            out.append(w)
            continue
        core = w.strip("\"'“”()[]*.,;:?!")
        if core in names and core[:1].isupper() and (out or core not in ("The", "What", "Which", "Is", "Does", "How")):
            tail = w[w.rfind(core) + len(core) :]
            if out and out[-1] == "§":
                out[-1] = "§" + tail
            else:
                out.append(w[: w.find(core)] + "§" + tail)
        else:
            out.append(_NUMBER.sub("#", w))
    return out


def breaks_off(caps: set[str], answer: str) -> bool:
    """Whether the surface shows that the answer was cut: an open quote or bracket, a comma, a word that needs another."""
    s = answer.rstrip()
    if not s:
        return False
    if s.count('"') % 2 or s.count("(") > s.count(")") or s.count("“") > s.count("”") or s.count("[") > s.count("]"):
        return True
    if s[-1] in ",;(-–—+=/&" or (s[-1] == ":" and len(s.split()) > 1):
        return True
    last = s.split()[-1]
    if last.lower() in OPEN_ENDS and len(s.split()) > 1:
        return True
    # A word of a name in the prompt that stops short, or a name that stops before its last word.
    if last.isalpha() and last[0].isupper() and last not in caps and len(last) >= 2 and any(c.startswith(last) for c in caps) and len(s.split()) > 1 and s.split()[-2].strip('"(') in caps:
        return True
    return False


def _judge(prompt: str | None, answer: str | None, may_decline: bool, model: LanguageModel) -> tuple[str | None, list[str] | None]:
    """(defect, None), or (None, wording) for pairs that the corpus must judge."""
    q, a = plain(prompt or ""), plain(answer or "")
    part = answer_part(a)
    if is_empty(part):
        return "empty", None
    p, t, caps = tokens_of(q), tokens_of(part), set(_NAME.findall(q))
    own = without_prompt(p, part, t)
    rest = t if own is part else tokens_of(own)
    if is_copy(p, t, rest):
        return "copies_question", None
    own, rest = (own, rest) if own else (part, t)
    if not may_decline and is_refusal(own, p):
        return "refusal", None
    names = {w.lower() for w in caps}
    if len(p) > 1 and "".join(q.split(None, 2)[1:2])[:1].islower():
        names.discard(p[0])  # a capital that only begins the sentence
    if other_language(q, p, names, own, rest, model):
        return "other_language", None
    said = own if part == a else without_prompt(p, a) or a
    if breaks_off(caps, said):
        return "truncated", None
    return None, wording(caps, said)


def beginnings(words: list[str]) -> list[int]:
    """A 64-bit number for each beginning of a wording, from none of its words to all."""
    h, out = 0, [0]
    for w in words:
        h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"), h)
        out.append(h - (1 << 63))
    return out


def pair_number(prompt: str | None, answer: str | None) -> int:
    """A 64-bit number of a pair, whatever its blanks and line ends."""
    q, a = (" ".join((s or "").split()) for s in (prompt, answer))
    return xxhash.xxh3_64_intdigest(f"{q}\n{a}".encode("utf-8", "replace")) - (1 << 63)


#: An answer is cut off if at most this share of the answers that begin with all its words end there, and this many go on.
END_SHARE, MIN_GO_ON = 0.12, 3


def defective_pairs(pairs: DataFrame, pair_id: str, prompt: str, answer: str, may_decline: Column, end_share: float = END_SHARE, min_go_on: int = MIN_GO_ON) -> DataFrame:
    """(pair_id, defect): the defective pairs with the first defect found, in the order empty, copies_question, refusal,
    other_language, truncated.

    may_decline: whether declining is right for the pair (null: it isn't). A null or blank answer is empty. Null prompts
    are taken as empty texts: their answers can't be copies or in another language. Repeated rows are judged each.
    Answers are judged by counts of different (prompt, answer) pairs, so copies of a row change no verdict. Beginnings are
    counted per different wording first, so very common answers are one row of the counts.
    """
    rows = pairs.select(F.col(pair_id).alias("pair_id"), F.col(prompt).alias("q"), F.col(answer).alias("a"), F.coalesce(may_decline, F.lit(False)).alias("may"))

    stops = stop_words(pairs.sparkSession)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of(stops)
        for b in batches:
            out = [_judge(q, a, m, model) for q, a, m in zip(b["q"], b["a"], b["may"])]
            full = pd.array([None if w is None else beginnings(w)[-1] for _, w in out], dtype="Int64")
            pair = pd.array([None if w is None else pair_number(q, a) for (_, w), q, a in zip(out, b["q"], b["a"])], dtype="Int64")
            yield pd.DataFrame({"pair_id": b["pair_id"], "defect": [d for d, _ in out], "words": [None if w is None else " ".join(w) for _, w in out], "full": full, "pair": pair})

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, n in zip(b["words"], b["n"]):
                words = text.split(" ")
                h = beginnings(words)
                rows += [(h[k], w, k + 1 == len(words), h[k + 1], n) for k, w in enumerate(words)]
                if len(rows) > 100_000:
                    yield pd.DataFrame(rows, columns=["begin", "word", "ends", "full", "n"])
                    rows = []
            yield pd.DataFrame(rows, columns=["begin", "word", "ends", "full", "n"])

    schema = T.StructType([T.StructField("pair_id", pairs.schema[pair_id].dataType), T.StructField("defect", T.StringType()), T.StructField("words", T.StringType()), T.StructField("full", T.LongType()), T.StructField("pair", T.LongType())])
    ship_package(pairs.sparkSession)
    judged = written(rows.mapInPandas(judge, schema), "pairs")
    known = judged.where("defect is not null").select("pair_id", "defect")
    different = judged.where("defect is null").groupBy("full", "pair").agg(F.first("words").alias("words"))
    kinds = different.groupBy("full").agg(F.count("*").alias("n"), F.first("words").alias("words"))
    # Every beginning of every wording, with the word that follows.
    steps = written(kinds.select("words", "n").mapInPandas(step, "begin long, word string, ends boolean, full long, n long"), "steps")
    nexts = steps.groupBy("begin", "word").agg(F.sum("n").alias("n"))
    begins = nexts.groupBy("begin").agg(F.sum("n").alias("go_on"), F.max(F.struct("n", "word")).alias("top"))
    ends = steps.where("ends").select("full", "n", F.col("begin").alias("stem"), F.col("word").alias("last"))
    j = ends.join(begins.select(F.col("begin").alias("full"), "go_on"), "full", "left").join(begins.select(F.col("begin").alias("stem"), "top"), "stem", "left")
    # Cut between words: most answers with all these words go on. Cut inside a word: the usual next word begins with it.
    between = (F.col("go_on") >= min_go_on) & (F.col("n") <= end_share * (F.col("n") + F.col("go_on")))
    inside = (F.col("top.word") != F.col("last")) & F.startswith(F.col("top.word"), F.col("last")) & (F.col("top.n") >= min_go_on) & (F.col("n") <= end_share * (F.col("n") + F.col("top.n")))
    cut = j.where(F.coalesce(between, F.lit(False)) | F.coalesce(inside, F.lit(False))).select("full")
    broken = lookup_join(judged.where("defect is null").select("pair_id", "full"), written(cut, "cut"), ["full"], "left_semi", ["pair_id"]).select("pair_id", F.lit("truncated").alias("defect"))
    return known.unionByName(broken)
