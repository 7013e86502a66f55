"""Defects of question and reply pairs, by ordered rules.

The rules run in the order of ``RULES``; each looks at the whole reply and names one defect, and all that
trigger are listed in that order, so the first is the main one:

- ``empty``: nothing is left without invisible characters, markup, labels, citations, punctuation and
  missing-value words; null too.
- ``copied_question``: without a label, lead-in, quotation marks and citations, the reply's character
  trigrams are almost those of the question.
- ``refusal``: a sentence refuses and no other sentence says anything, though the question should be
  answered.
- ``truncated``: a delimiter of code, citation or list stays open, or the last sentence has no end.
- ``other_language``: the prose (no code, identifiers, quotations) is in another script or language.

An empty reply has no other defect. An abstention is in no language, unless the question should be answered.
The prose's language is told by its script, else by its frequent words; where neither tells it, the pair is not
judged by ``other_language`` and the language column is null.
A copied question or a reply that only refuses breaks off where a delimiter stays open or the text ends in
the middle of a phrase; a missing full stop alone is no sign there, as both are often given without one.

Defined cases: replies without a question id, or whose question doesn't exist, are no pairs and give no
row. A re-logged reply counts once, as its latest row says, likewise a question. ``expect_abstain`` null is
not false. Blank questions can't be copied and have no language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import batch

RULES = ("empty", "copied_question", "refusal", "truncated", "other_language")

# Words that stand for a missing value, and labels.
MISSING = frozenset("null none nil nan n/a na undefined missing unknown void".split()) | {"n.a"}
LABELS = frozenset("answer answers reply response result output antwort respuesta réponse resposta risposta ответ 回答 答え 答案 إجابة उत्तर คำตอบ evidence question assistant".split())
# What may stand before a repeated question.
LEAD_INS = (
    "sure", "ok", "okay", "well", "hi", "hello", "yes", "question", "q", "you asked", "the question is", "the question was", "your question", "quick question", "tell me",
    "frage", "die frage lautet", "sie fragten", "du fragst", "gut", "pregunta", "la pregunta es", "preguntaste", "usted preguntó", "claro", "bien", "質問", "ご質問", "はい", "問い", "问题", "question posée", "вопрос",
)
# Phrases that refuse or abstain, by language.
REFUSALS = {
    "en": (
        r"\b(?:i|we)(?:['’]m| am| are|['’]re)?(?: \w+)? (?:can(?:no|['’])?t|can not|could(?: not|n['’]t)|won['’]t|will not|unable|not able|not allowed|not permitted)\b.{0,30}?\b(?:answer|help|say|tell|discuss|comment|determine|assist|provide|explain|share|respond|speak|talk|disclose|find)\b",
        r"\b(?:must|have to|need to|i) decline\b", r"\bfalls? outside\b", r"\b(?:not|in|(?:do|does|did|is|was|are)n['’]t)\s?(?:have |is |be )?(?:enough|sufficient)\b.{0,60}?(?:tell|say|answer|context|information|go on)",
        r"\bno answer (?:is|can)\b", r"\bnothing in the\b.{0,40}\b(?:covers?|mentions?|answers?|says?|describes?|addresses?|shows?)\b", r"\bdo(?:es)?(?: not|n['’]t) (?:say|mention|contain|cover|show|include|answer|address) (?:anything|any|enough|it|this|the)?",
        r"\bstops? short of\b", r"\brather not (?:guess|say|answer)\b", r"\bguidelines? (?:keep|prevent|stop|forbid)\b", r"\bnone of the\b.{0,40}\b(?:answers?|covers?|mentions?|says?)\b", r"\bi (?:do not|don['’]t) (?:know|have (?:any |enough )?information)\b",
    ),
    "de": (
        r"\bkann\b.{0,80}\bnicht (?:beantworten|helfen|sagen|beurteilen|weiterhelfen)\b", r"\bnicht (?:beantworten|helfen|weiterhelfen)\b.{0,12}\bkann\b", r"\breicht\b.{0,80}\bnicht aus\b", r"\bkeine (?:auskunft|informationen|angaben|antwort)\b",
        r"\bdarf\b.{0,60}\b(?:keine|nicht)\b", r"\bnicht (?:genug|genügend|ausreichend)\b", r"\bgeht\b.{0,40}\bnicht hervor\b", r"\bsteht\b.{0,40}\bnichts\b",
    ),
    "es": (
        r"\bno (?:puedo|podemos|es posible|me es posible)\b.{0,40}\b(?:responder|contestar|ayudar|decir|hablar|comentar|determinar)\w*", r"\bno (?:tengo|tenemos|dispongo de) (?:permiso|permitido|suficiente|información|autorización)\b",
        r"\bno (?:dicen|dice|mencionan?|contienen?|cubren?|explican?) (?:nada|información|lo suficiente)\b", r"\bno hay (?:suficiente|bastante|información|contexto)\b", r"\bningun[oa]? de (?:los|las)\b.{0,40}\brespond",
    ),
    "fr": (r"\bje ne (?:peux|puis|sais|suis) pas\b", r"\bne (?:dit|disent|mentionnent?|contiennent|contient|permet(?:tent)?) (?:rien|pas)\b", r"\bimpossible de répondre\b", r"\baucun\w*\b.{0,40}\bne répond"),
    "ja": (r"(?:お答え|回答|お手伝い|お応え|説明|判断)(?:は|が|を|すること(?:は|が))?(?:いた)?(?:でき(?:ません|ない|かね)|しかね)", r"情報が(?:見つから|足り|不足|あり(?:ません))", r"分かりません|わかりません|許可されていません"),
    "zh": (r"无法(?:回答|提供|确定|帮助)", r"不能(?:回答|提供|讨论)", r"没有(?:足够|相关)", r"不足以回答"),
    "ko": (r"(?:답변|도움|말씀|판단)(?:을|를|은|는)?\s?(?:드리기|드릴|할|하기|줄)?\s?(?:수\s?)?(?:없|어렵)", r"정보가 (?:없|부족|충분하지)"),
    "ar": (r"لا (?:أستطيع|يمكنني|يمكننا|أقدر)", r"لا (?:تحتوي|تذكر|توجد|يوجد)", r"معلومات غير كافية"),
    "hi": (r"(?:उत्तर|जवाब|मदद) नहीं (?:दे|कर)", r"जानकारी (?:नहीं|पर्याप्त नहीं)"),
    "th": (r"ไม่สามารถ(?:ตอบ|ช่วย|ให้)", r"ข้อมูลไม่(?:เพียงพอ|มี)"),
    "pt": (r"\bnão (?:posso|podemos|consigo|é possível|tenho|há)\b.{0,40}\b(?:responder|ajudar|dizer|informaç|suficiente|determinar)",),
    "it": (r"\bnon (?:posso|possiamo|riesco|è possibile|ho|ci sono)\b.{0,40}\b(?:rispondere|aiutare|dire|informazioni|sufficient|determinare)",),
    "ru": (r"не (?:могу|можем) (?:ответить|помочь|сказать|обсуждать)", r"недостаточно (?:информации|контекста|данных)", r"не (?:содержит|содержат|говорит|говорят) (?:ничего|информации)"),
}
# Each phrase above holds one of these, lower-cased; replies without any aren't searched for phrases.
ANCHORS = (
    "can't", "can’t", "cant", "cannot", "can not", "could not", "couldn", "won't", "won’t", "will not", "unable", "not able", "not allowed", "not permitted", "decline", "outside",
    "enough", "sufficient", "no answer", "nothing in the", "do not", "don't", "don’t", "does not", "doesn't", "doesn’t", "short of", "rather not", "guideline", "none of the",
    "nicht", "keine", "no puedo", "no podemos", "no es posible", "no me es", "no tengo", "no tenemos", "no dispongo", "no dice", "no mencion", "no contien", "no cubre", "no explica", "no hay", "ningun",
    "je ne ", "ne dit", "ne disent", "ne mention", "ne contien", "ne permet", "impossible de", "aucun", "ません", "ない", "かね", "无法", "不能", "没有", "不足以", "не ", "недостаточно",
    "없", "어렵", "부족", "충분하지", "لا ", "غير كافية", "नहीं", "ไม่", "não ", "non ",
)
# Sentences that send the reader elsewhere or apologise, and say nothing themselves.
REDIRECTS = re.compile(
    r"^(?:please|try|you (?:may|might|could)|perhaps|maybe|consider|ask|contact|bitte|versuche?n?|frage?n? sie|consulte|consulta|pruebe|intente|por favor|pregunte|veuillez|essayez|sorry|i(?:['’]m| am) sorry|i apologi[sz]e|unfortunately|leider|tut mir leid|lo siento|por desgracia|申し訳|すみません|別の|担当|抱歉|对不起|пожалуйста|к сожалению|попробуйте)",
    re.I,
)
# Frequent words that tell the languages of the Latin script apart.
FREQUENT = {
    "en": "a the of and to in is that it for with as on because without while until into out over between never under about this which from by be are was not but when what does who how why would where can one no each after before only every all its they if than then so has have been at there an or yes",
    "de": "der die das und ist nicht mit von den zu ein eine auf wird im für dem des aus nach am bei wenn was wo wie wer warum sich auch nur an als oder pro etwa jede zeile siehe bitte kann wurde liefert welche liest bis noch",
    "es": "el la de que y en los una un por con para del se las al lo como cuando qué dónde cómo quién su es no más cada este esta entre porque después según sobre vez veces véase devuelve dos",
    "fr": "le les des une du est dans pour pas sur ne et au aux ce cette qui que avec par plus ou où jamais pourquoi chaque ligne voir après avant deux fois la de un il elle en relu demande",
}
# Letters that speak for a language.
_LETTERS = {"es": "¿¡ñ", "de": "ßüä", "fr": "çèêà", "pt": "ãõ", "it": "ìò"}
# Words that can't stand last.
DANGLING = frozenset("the a an of and to in is that for with as on which from by be are was but when if or since because than then its this such der die das und ist mit von den zu ein eine auf im für weil wenn dass el los una un por con para del que y en porque cuando le les des une du et dans pour sur qui avec".split())

_INVISIBLE = re.compile("[​-‏ -‮⁠-⁤﻿­᠎\u0000-\u0008\u000e-\u001f]")
_CONTROL = re.compile("[\u0000-\u0008\u000e-\u001f]")
_CITATION = re.compile(r"\[\s*C\d+(?:\s*[,;]\s*C\d+)*\s*\]")
_OPEN_CITATION = re.compile(r"\[\s*(?:C(?:\d+(?:\s*[,;]\s*(?:C\d*)?)*)?)?\s*$")
_TAG = re.compile(r"</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>")
_FENCED = re.compile(r"(```|~~~)[^\n]*\n.*?(?:\1|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“\n]*“|«[^»\n]*»|「[^」\n]*」|『[^』\n]*』")
_IDENTIFIER = re.compile(r"\b\w*(?:_\w|[a-z][A-Z]|\d)\w*(?:\.\w+)*|\b\w+\.\w+\b|\b\w+\(\)", re.A)
_WORD = re.compile(r"[^\W\d_]+")
_ENDED = re.compile(r"[.!?。！？।؟…۔]['\"”»」』)*_\]}’]*\s*$")
_LIST_LINE = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+\S")
_BARE_MARK = re.compile(r"\s*(?:\d+[.)]|[-*+•])\s*$")
_SENTENCE = re.compile(r"(?<=[.!?。！？])(?:\s+|(?=[^\s\W]))|\n+")
_REFUSES = re.compile("|".join(f"(?:{p})" for ps in REFUSALS.values() for p in ps), re.I)
_LEAD = re.compile(rf"^(?:{'|'.join(sorted(map(re.escape, LEAD_INS), key=len, reverse=True))})(?=[\s:：.,!，、。-])[\s:：.,!，、。-]*", re.I)
_SCRIPTS = (("ja", re.compile("[぀-ヿ]")), ("ru", re.compile("[Ѐ-ӿ]")), ("ar", re.compile("[؀-ۿ]")), ("hi", re.compile("[ऀ-ॿ]")), ("th", re.compile("[฀-๿]")), ("ko", re.compile("[가-힣]")), ("zh", re.compile("[一-鿿]")))
_HOLDERS: dict[str, set[str]] = {}
for _lang, _words in FREQUENT.items():
    for _w in _words.split():
        _HOLDERS.setdefault(_w, set()).add(_lang)
#: A word counts for each of its languages by an equal part.
_VOTES = {w: [(g, 1 / len(gs)) for g in sorted(gs)] for w, gs in _HOLDERS.items()}
#: What is no prose, with marks without which it isn't there.
_NOT_PROSE = ((("```", "~~~"), _FENCED), ("[", _CITATION), ("`", _INLINE), ('"“„«「『', _QUOTED), ("<", _TAG), (("",), _IDENTIFIER))


def visible(text: str) -> str:
    """``text`` without invisible characters."""
    return text if text.isascii() and not _CONTROL.search(text) else _INVISIBLE.sub("", text)


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    head = text[:120]
    if head.isascii() and "<" not in head and "[" not in head and not _INVISIBLE.search(head):
        # words that nothing removes, too many and too long for a label or a missing value
        words = _WORD.findall(head)
        if len(words) > 3 and sum(map(len, words)) > 16:
            return False
    bare = _TAG.sub(" ", _CITATION.sub(" ", _INVISIBLE.sub("", text)))
    if re.sub(r"[\s.]+", "", bare.lower()).strip("*_`#>\"'()[]") in MISSING:
        return True
    words = re.findall(r"\w+", bare.replace("_", " "))
    if not words:
        return True
    if len(words) <= 2 and all(w.lower() in LABELS for w in words):
        return True
    return re.sub(r"\w*", "", bare.strip()) == "```\n```" and all(w.isalpha() for w in words) and bare.strip().startswith("```") and len(words) == 1


def _plain(text: str) -> str:
    return "".join(filter(str.isalnum, text.lower()))


def _trigrams(text: str) -> Counter[str]:
    return Counter(map("".join, zip(text, text[1:], text[2:]))) if len(text) > 2 else Counter([text] if text else [])


class Asked:
    """What the rules need to know of a question, made once for all its replies: its language, and its
    trigrams with and without its lead-in, each with their number."""

    def __init__(self, question: str | None):
        self.language = language(question or "")
        whole = _plain(question or "")
        own = dict.fromkeys((whole, _plain(_without_lead(question.strip())))) if whole else ()
        self.forms = [(sum(t.values()), t) for t in map(_trigrams, own)]


def _without_lead(text: str) -> str:
    m = _LEAD.match(text)
    return text[m.end() :] if m else text


def is_copied(text: str, asked: Asked, least: float = 0.8) -> bool:
    """Whether the Dice similarity of the character trigrams reaches ``least``."""
    if not asked.forms:
        return False
    reply = visible(text)
    reply = (_CITATION.sub("", reply) if "[" in reply else reply).strip()
    for _ in range(3):
        cut = _without_lead(reply.strip(" \t\n*_>#\"'“”„«»「」`")).strip()
        if cut == reply:
            break
        reply = cut
    plain = _plain(reply)
    n = max(len(plain) - 2, 1 if plain else 0)
    # the smaller number of trigrams bounds what both have
    able = [(m, b) for m, b in asked.forms if 2 * min(n, m) >= least * (n + m)]
    if not able:
        return False
    a = _trigrams(plain)
    return any(2 * sum(min(c, b[g]) for g, c in a.items() if g in b) >= least * (n + m) for m, b in able if n + m)


def refuses(text: str) -> bool:
    """Whether a sentence refuses and no other says anything."""
    low = text.lower()
    if not any(a in low for a in ANCHORS):
        return False
    found = False
    for s in _SENTENCE.split(visible(text).strip()):
        s = s.strip(" \t*_>\"'“”„«»「」")
        if not s:
            continue
        if _REFUSES.search(_QUOTED.sub(" ", s)) or _REFUSES.search(s) and '"' not in s:
            found = True
            continue
        cited = _CITATION.sub("", s).strip()
        if not cited or REDIRECTS.match(cited) and not _IDENTIFIER.search(cited):
            continue
        if _IDENTIFIER.search(cited) or _INLINE.search(cited) or len(_WORD.findall(cited)) > 5 or len(cited) > 40:
            return False
        if not cited.isascii() and len(cited) > 12:
            return False
    return found


def is_truncated(text: str, needs_end: bool = True) -> bool:
    """Whether ``text`` breaks off; without ``needs_end``, a missing end of the last sentence is no sign."""
    body = visible(text).rstrip()
    if ("```" in body or "~~~" in body) and len(re.findall(r"^[ \t]*(?:```|~~~)", body, re.M)) % 2:
        return True
    lines = body.split("\n")
    last = lines[-1]
    if last.strip().startswith(("```", "~~~")):
        return False
    outside = _FENCED.sub("\n", body) if "```" in body or "~~~" in body else body
    if outside.count("`") % 2 or "[" in last and _OPEN_CITATION.search(last):
        return True
    if _BARE_MARK.match(last) and len(lines) > 1:
        return True
    if _ENDED.search(body, max(0, len(body) - 40)) or _CITATION.search(body[-40:]) and _CITATION.sub("", last).strip() != last.strip() and re.search(r"\]\s*[*_)\"”]*$", body):
        return last.count("(") > last.count(")") and last.rstrip().endswith(("...", "…"))
    if _LIST_LINE.match(last):
        return bool(re.search(r"[,;:(\[]$", last)) or _last_word(last) in DANGLING and "`" not in last[-3:]
    if re.search(r"[,;:(\[-]$", body):
        return True
    # a reply of one phrase needs no end
    if len(lines) == 1 and not re.search(r"[.!?。！？]\s", body) and len(body.split()) <= 6 and (body.isascii() or not _ja(body)):
        return _last_word(body) in DANGLING
    return needs_end or _last_word(body) in DANGLING


def _ja(text: str) -> bool:
    return len(text) > 24 and bool(re.search("[぀-ヿ一-鿿]", text))


def _last_word(text: str) -> str:
    words = re.findall(r"[^\W\d]+", text.lower())
    return words[-1] if words else ""


def prose(text: str) -> str:
    for marks, pattern in _NOT_PROSE:
        if any(m in text for m in marks):
            text = pattern.sub(" ", text)
    return text


def language(text: str) -> str | None:
    """The language of the prose in ``text``; None if it can't be told."""
    p = prose(text)
    words = _WORD.findall(p.lower())
    if not words:
        return None
    if not p.isascii():
        letters = sum(map(len, words))
        for name, pattern in _SCRIPTS:
            own = len(pattern.findall(p))
            if own >= 4 and own * (4 if name == "zh" else 5) >= letters:
                return name
    votes: dict[str, float] = {}
    for w in words:
        for g, part in _VOTES.get(w, ()):
            votes[g] = votes.get(g, 0.0) + part
    if not p.isascii():
        low = p.lower()
        for g, cs in _LETTERS.items():
            n = sum(map(low.count, cs))
            if n:
                votes[g] = votes.get(g, 0.0) + 0.5 * min(2, n)
    if not votes:
        return None
    first = max(sorted(votes), key=votes.__getitem__)
    rest = max((n for g, n in votes.items() if g != first), default=0.0)
    return first if votes[first] >= 1.5 and votes[first] > 1.3 * rest else None


def defects(text: str | None, question: str | None, expect_abstain: bool | None, asked: Asked | None = None) -> list[str]:
    return _defects(text, asked or Asked(question), expect_abstain)[0]


def _defects(text: str | None, asked: Asked, expect_abstain: bool | None) -> tuple[list[str], str | None]:
    """The defects, and the language of the reply's prose as far as it was judged."""
    if is_empty(text):
        return ["empty"], None
    copied, refusing = is_copied(text, asked), refuses(text)
    abstains = refusing and expect_abstain is not False
    out = ["copied_question"] if copied else []
    if refusing and not abstains:
        out.append("refusal")
    if is_truncated(text, needs_end=not (copied or refusing)):
        out.append("truncated")
    told = language(text) if asked.language and not abstains else None
    if told and told != asked.language:
        out.append("other_language")
    return out, told


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, Asked] = {}
    for b in batches:
        rows = []
        for i, text, question, abstain in zip(*(c.to_pylist() for c in b.columns)):
            asked = known.get(question)
            if asked is None:
                if len(known) >= 20_000:
                    known.clear()
                asked = known[question] = Asked(question)
            found, told = _defects(text, asked, abstain)
            if found:
                rows.append((i, found, asked.language, told))
        ids, found, langs, told = zip(*rows) if rows else ((), (), (), ())
        yield batch(
            ("answer_id", "defects", "question_lang", "reply_lang"),
            (pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(langs, pa.string()), pa.array(told, pa.string())),
        )


def broken_pairs(
    answers: DataFrame, answer_id: str, question_id: str, text: str, logged: str,
    questions: DataFrame, question: str, abstain: str, created: str, salts: int = 8,
) -> DataFrame:
    """``answer_id, defects, question_lang, reply_lang`` of each pair that has any defect. Questions are repeated ``salts`` times so that the
    replies to one question spread over as many tasks."""
    newest = lambda by, *cols: F.max_by(F.struct(*cols), F.coalesce(F.col(by).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")))
    reply = answers.where(F.col(answer_id).isNotNull()).groupBy(F.col(answer_id).cast("long").alias("answer_id"))
    reply = reply.agg(newest(logged, F.col(question_id).cast("long").alias("qid"), F.col(text).alias("text")).alias("r")).select("answer_id", "r.qid", "r.text")
    asked = questions.where(F.col(question_id).isNotNull()).groupBy(F.col(question_id).cast("long").alias("qid"))
    asked = asked.agg(newest(created, F.col(question).alias("question"), F.col(abstain).alias("abstain")).alias("q")).select("qid", "q.question", "q.abstain")
    salt: Column = F.pmod(F.xxhash64("answer_id"), F.lit(salts)).cast("int")
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = reply.where("qid is not null").withColumn("salt", salt).join(asked, ["qid", "salt"])
    return pairs.select("answer_id", "text", "question", "abstain").mapInArrow(_judge, "answer_id long, defects array<string>, question_lang string, reply_lang string")
