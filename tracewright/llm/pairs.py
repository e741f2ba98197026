"""Broken pairs of prompt and response, each with its defect.

* ``empty``      nothing but blanks, an empty fence or an empty JSON value
* ``truncated``  as :mod:`tracewright.llm.truncation` finds it (end model, delimiter stack)
* ``refusal``    little more than a phrase that declines; phrases are found by one
  Aho-Corasick automaton over all of them
* ``copy``       the prompt or its question again: the response is traversed through the
  suffix automaton of the prompt, which gives the longest match that ends at each
  character, and nearly all of it lies in long matches
* ``language``   prose in another language than the question's, by stopword votes, unless
  the prompt asks for it

All but the end model look at one row only.  A row has one defect at most; the order above
decides, except that a whole copy or refusal is never called truncated.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import jsontext
from tracewright.llm import truncation
from tracewright.llm.language import _HAN, prose, votes
from tracewright.session import spread

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")

# ---------------------------------------------------------------- empty

_BLANK = re.compile(r"[\s​‌‍⁠﻿ ]+")
_FENCE = re.compile(r"```[\w+-]*")


def _no_content(value) -> bool:
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, (dict, list)):
            stack.extend(v.values() if isinstance(v, dict) else v)
        elif isinstance(v, str):
            if not _blank(v):
                return False
        elif v is not None:
            return False
    return True


def _blank(text: str) -> bool:
    return not _FENCE.sub("", _BLANK.sub(" ", text)).strip()


def is_empty(text: str | None) -> bool:
    """Blank, an empty fence, or JSON that holds no content: nulls, blanks and what holds only those."""
    if not text:
        return True
    s = _FENCE.sub("", _BLANK.sub(" ", text)).strip()
    if not s or s == "null":
        return True
    if s[0] + s[-1] in ("{}", "[]", '""'):
        try:
            return _no_content(jsontext.load(s))
        except ValueError:
            return False
    return False


# ---------------------------------------------------------------- refusal

#: Phrases by which a speaker declines; letters at their ends must not go on.
REFUSALS = (
    "i can't help", "i cannot help", "i can not help", "i can't assist", "i cannot assist", "something i can assist", "something i can help", "i am unable to", "i'm unable to", "i won't be able to", "i will not be able to",
    "i must decline", "i have to decline", "i need to decline", "i decline", "must respectfully decline", "request cannot be fulfilled", "request can't be fulfilled", "i cannot fulfil", "i can't fulfil", "i cannot fulfill", "i can't fulfill", "i cannot comply", "i can't comply",
    "against my guidelines", "i'm not comfortable", "i am not comfortable", "i will not continue", "i won't continue", "what i am allowed", "what i'm allowed", "i am not allowed", "i'm not allowed", "i can't do that", "i cannot do that", "i cannot provide", "i can't provide", "i must refuse", "i have to refuse", "i refuse",
    "i'm not able to", "i am not able to", "i cannot answer", "i can't answer", "i cannot continue", "i can't continue", "i don't feel comfortable",
    "我無法", "我无法", "恕我", "恕無法", "恕无法", "無法協助您", "无法协助您", "超出我可以", "超出我能", "超出了我", "必須婉拒", "必须婉拒", "我婉拒", "我不能", "我拒絕", "我拒绝", "不便提供", "不便回答", "無法處理這個請求", "无法处理这个请求", "不能提供協助", "不能提供协助",
    "kann ich nicht helfen", "kann ich leider nicht", "kann ich ihnen nicht", "kann ich nicht beantworten", "kann ich nicht weiterhelfen", "muss ich ablehnen", "muss ich leider ablehnen", "ich muss ablehnen", "ich lehne", "darf ich nicht", "ich darf nicht", "ist mir nicht erlaubt", "ich kann dabei nicht helfen",
    "no puedo ayudar", "no puedo ayudarte", "no puedo ayudarle", "no me es posible", "debo rechazar", "debo negarme", "tengo que rechazar", "no puedo responder", "no puedo continuar", "no estoy autorizado", "no estoy autorizada", "no puedo atender", "no puedo proporcionar",
)
#: Sentences at the beginning within which a refusal is pronounced.
REFUSAL_SENTENCES = 2


class PhraseAutomaton:
    """Aho-Corasick over casefolded phrases: does a text contain any of them?  ``words``: not within longer words of letters."""

    def __init__(self, phrases: tuple[str, ...], words: bool = False) -> None:
        self.words = words
        self.next: list[dict[str, int]] = [{}]
        self.fail = [0]
        self.ends: list[tuple[int, ...]] = [()]  # lengths of the phrases that end here
        for p in phrases:
            at = 0
            for c in p.casefold():
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.ends.append(())
                at = self.next[at][c]
            self.ends[at] += (len(p.casefold()),)
        todo = deque(self.next[0].values())
        while todo:
            at = todo.popleft()
            for c, to in self.next[at].items():
                f = self.fail[at]
                while f and c not in self.next[f]:
                    f = self.fail[f]
                self.fail[to] = self.next[f].get(c, 0) if self.next[f].get(c, 0) != to else 0
                self.ends[to] += self.ends[self.fail[to]]
                todo.append(to)

    def search(self, text: str) -> bool:
        at = 0
        s = text.casefold().replace("’", "'")
        for i, c in enumerate(s):
            while at and c not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(c, 0)
            if self.ends[at] and (not self.words or any(not _goes_on(s, i - n, i - n + 1) and not _goes_on(s, i, i + 1) for n in self.ends[at])):
                return True
        return False


def _goes_on(s: str, i: int, j: int) -> bool:
    """Do the characters at two neighbouring places belong to one word of letters?"""
    return i >= 0 and j < len(s) and s[i].isalpha() and s[j].isalpha() and s[i] < "\u2e80" and s[j] < "\u2e80"


_REFUSES = PhraseAutomaton(REFUSALS, words=True)


def _texts_of(value) -> Iterator[str]:
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, dict):
            stack.extend(v.values())
        elif isinstance(v, list):
            stack.extend(v)


def said(text: str) -> str:
    """What a response says: of a JSON value its texts, else the response."""
    s = text.strip()
    if s[:1] in ("{", "["):
        try:
            return "\n".join(t for t in reversed(list(_texts_of(jsontext.load(s)))) if t.strip())
        except ValueError:
            pass
    return text


_CODE_LINE = re.compile(r"(?m)^\s*(?:return|def|class|import|from|if|for|while|public|private|protected|[\w.\[\]]+ = |[\w.]+\([^)]*\);?$)")


def is_refusal(text: str) -> bool:
    """A text of any length whose first sentences decline and which gives no code after all."""
    s = said(text).strip()
    head = "".join(_SENTENCE.findall(re.sub(r"`[^`\n]*`", "x", s))[:REFUSAL_SENTENCES])
    return _REFUSES.search(head) and "```" not in s and not _CODE_LINE.search(s.lstrip("# "))


_SENTENCE = re.compile(r"[^.!?。！？\n]*(?:[.!?](?!\s)[^.!?。！？\n]*)*(?:[.!?。！？\n]+|\Z)")


# ---------------------------------------------------------------- copy

#: A match of the prompt counts from this many characters.
COPY_RUN = 12
#: Share of the response that lies in such matches, and characters it may add (a label, a fence).
COPY_SHARE = 0.9
COPY_EXTRA = 40
#: A shorter response is not called a copy; a Chinese character counts as two.
COPY_LEAST = 20
#: The same for a response that is mostly Chinese, whose words are shorter.
COPY_RUN_HAN = 6

_MARKS = re.compile(r"^[ \t]*(?:>[ \t]?)+|```\w*|[*_#]{2,}", re.M)


def plain(text: str) -> str:
    """Casefolded, with quote marks, fences and runs of blanks taken out."""
    return " ".join(_MARKS.sub(" ", text).casefold().split())


class SuffixAutomaton:
    """All substrings of a text in linear space; ``matches`` gives the longest one ending at each character."""

    def __init__(self, text: str) -> None:
        nxt: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text:
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next, self.link, self.length = nxt, link, length

    def matches(self, text: str) -> list[int]:
        out, at, n = [], 0, 0
        nxt, link, length = self.next, self.link, self.length
        for c in text:
            while at and c not in nxt[at]:
                at = link[at]
                n = length[at]
            if c in nxt[at]:
                at = nxt[at][c]
                n += 1
            else:
                at = n = 0
            out.append(n)
        return out


def coverage(prompt: str, response: str, run: int = COPY_RUN) -> tuple[int, int]:
    """(characters of the response in matches of at least ``run``, its characters)."""
    ends = np.array(SuffixAutomaton(prompt).matches(response))
    mark = np.zeros(len(response) + 1, np.int64)
    hit = np.flatnonzero(ends >= run)
    np.add.at(mark, hit - ends[hit] + 1, 1)
    np.add.at(mark, hit + 1, -1)
    return int((np.cumsum(mark)[:-1] > 0).sum()), len(response)


def _at_most(prompt: str, response: str, run: int) -> int:
    """An upper bound of the characters of the response that lie in matches of ``run`` and more.

    Every such character lies in a piece of ``run`` characters that stands in the prompt, so
    no copy is lost by asking this bound before the automaton is built.  It is 0 once more than
    ``COPY_EXTRA`` characters lie in none, which no copy has.
    """
    n = len(response)
    end = missing = 0
    for i in range(n):
        if i <= n - run and response[i : i + run] in prompt:
            end = i + run
        elif i >= end:
            missing += 1
            if missing > COPY_EXTRA:
                return 0
    return n - missing


def is_copy(prompt: str | None, response: str) -> bool:
    """Does the response give the prompt or its question back and add nothing?"""
    if not prompt:
        return False
    p, r = plain(prompt), plain(response)
    n, han = len(r), len(_HAN.findall(r))
    if n + han < COPY_LEAST:
        return False
    run = COPY_RUN_HAN if 2 * han > n else COPY_RUN

    def enough(covered: int) -> bool:
        rest = n - covered
        return covered >= COPY_SHARE * n and rest <= COPY_EXTRA or (covered + han >= COPY_LEAST and rest <= min(COPY_EXTRA // 2, covered // 2) and r.endswith(p[-run:]))

    return enough(_at_most(p, r, run)) and enough(coverage(p, r, run)[0])


# ---------------------------------------------------------------- language

#: Verbs of what a model is asked to do, and question words, by language.
_ASKS = {
    "en": r"(?i)^(?:please )?(?:explain|describe|tell|show|compare|summari[sz]e|list|translate|rewrite|port|give|write|implement|convert|which|why|how|what|can you|could you)\b",
    "zh": r"為什麼|为什么|如何|怎麼|怎么|哪[一個个些]|(?:請|请)(?:你|您|幫我|帮我)*(?:解釋|解释|說明|说明|描述|列出|列舉|列举|用|把|將|将|提出|寫|写|改|給|给|翻譯|翻译|移植|比較|比较|摘要|總結|总结|實作|实现|轉|转)|^(?:依|按|根據|根据)[^，。]*(?:寫|写|改|列|譯|译)",
    "de": r"(?i)^(?:bitte )?(?:erkläre|beschreibe|fasse|schreibe|übertrage|übersetze|nenne|liste|vergleiche|warum|weshalb|wieso|welche[rs]?|wozu|wie|was)\b|^bitte\b.*\b(?:erklären|beschreiben|zusammenfassen|schreiben|umschreiben|übertragen|übersetzen|nennen|auflisten|vergleichen)\b",
    "es": r"(?i)^(?:por favor,? )?(?:explica|describe|resume|reescribe|pasa|convierte|enumera|traduce|escribe|compara)\b|¿",
}
_ASK_RE = {k: re.compile(v) for k, v in _ASKS.items()}
_NAMES = {
    "en": r"english|英文|英語|englisch|inglés",
    "zh": r"chinese|中文|chinesisch|chino",
    "de": r"german|德文|德語|deutsch|alemán",
    "es": r"spanish|西班牙文|西班牙語|spanisch|español",
}
_WANTS = re.compile(
    r"(?i)(?:answer|reply|respond|write|please answer)\s+(?:in|with)\s+(\w+)|(?:請|请)?用\s*(\w{2,5}?)\s*(?:回答|回覆|作答)|auf\s+(\w+)\s+(?:antworten|beantworten)|(?:responde|contesta|responder)\s+en\s+(\w+)"
)


def asked_language(prompt: str) -> str | None:
    """The language a prompt asks the answer to be in; the last request counts."""
    found = None
    for m in _WANTS.finditer(prompt):
        name = next(g for g in m.groups() if g)
        for lang, names in _NAMES.items():
            if re.fullmatch(names, name.casefold()):
                found = lang
    return found


def winner(text: str, least: int = 3, share: float = 0.6) -> str | None:
    """Language with a clear majority of the votes."""
    v = votes(text)
    best = max(v, key=lambda k: (v[k], k))
    return best if v[best] >= least and v[best] >= share * sum(v.values()) else None


_SENTENCE_END = re.compile(r"(?<=[.!?。？！])\s*|\n+")


def question_language(prompt: str) -> str | None:
    """Language of the sentence that asks: the last question or task of the prompt.

    Where there is none, the language of all the prompt's prose.
    """
    text = prose(prompt)
    found = None
    for s in _SENTENCE_END.split(text):
        s = s.strip()
        if len(s) < 4 or _WANTS.search(s):
            continue
        if len(_HAN.findall(s)) >= 3:
            if s.endswith("？") or _ASK_RE["zh"].search(s):
                found = "zh"
            continue
        if s.endswith("?"):
            found = winner(s, 1) or found
            continue
        # words of two languages (describe) go by the votes of the rest
        lang = next((k for k in ("de", "es", "en") if _ASK_RE[k].search(s)), None)
        if lang:
            found = winner(s, 2) or lang
    return found or winner(text)


def answer_language(response: str) -> str | None:
    """Language of a response's prose; None for code and for texts of hardly any words."""
    s = response.strip()
    form = truncation.form(s)
    if form in (2, 3):
        return None
    if form == 1:
        try:
            parts = [t for t in _texts_of(jsontext.load(s)) if not _codelike(t)]
            return winner(prose("\n".join(parts)))
        except ValueError:
            pass
    return winner(prose(s))


def _codelike(text: str) -> bool:
    return len(re.findall(r"\w\(|\)\n|\\n| = |\w\.\w", text)) > 2 and truncation.form(text) == 3


def wrong_language(prompt: str | None, response: str) -> bool:
    if not prompt:
        return False
    said_in = answer_language(response)
    if not said_in:
        return False
    asked = question_language(prompt)
    return asked is not None and said_in not in (asked, asked_language(prompt))


# ---------------------------------------------------------------- all together


def defects(prompts: list[str | None], responses: list[str | None], statuses: list[str | None], elsewhere: list[bool], cut: np.ndarray) -> list[str | None]:
    """The defect of each pair; ``cut`` marks the responses that break off."""
    out: list[str | None] = []
    for p, r, status, kept, is_cut in zip(prompts, responses, statuses, elsewhere, cut):
        if is_empty(r):
            out.append("empty" if status == "ok" and not kept else None)
        elif is_refusal(r):
            out.append("refusal")
        elif is_cut:
            out.append("truncated")
        elif is_copy(p, r):
            out.append("copy")
        elif wrong_language(p, r):
            out.append("language")
        else:
            out.append(None)
    return out


def find_defects(traces: DataFrame, *, fitted=None) -> DataFrame:
    """(id, defect) of every defective pair of the finished calls of ``traces``.

    Columns read: id, prompt, response, status, response_payload_key.  Rows with status
    ``running`` are left out.  A null prompt rules out ``copy`` and ``language``; a null
    response is ``empty`` at status ``ok`` unless its payload is kept elsewhere, and no
    defect otherwise.
    """
    done = truncation.finished(traces)
    model, limits = fitted or truncation.fit(done, "response")
    narrow = done.select(
        F.col("id").cast("bigint").alias("id"), "prompt", "response", "status", F.col("response_payload_key").isNotNull().alias("elsewhere")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prompts, responses = b.column(1).to_pylist(), b.column(2).to_pylist()
            cut = np.zeros(b.num_rows, bool)
            for _, rows, texts in truncation._steps(iter([b]), "response"):
                cut[rows] = truncation.cut_flags(model, limits, texts, [prompts[i] for i in rows])
            got = defects(prompts, responses, b.column(3).to_pylist(), b.column(4).to_pylist(), cut)
            keep = [i for i, d in enumerate(got) if d]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array([got[i] for i in keep], pa.string())], ["id", "defect"]
            )

    return spread(narrow).mapInArrow(run, "id bigint, defect string")
