"""A small deterministic analyser for sentences and element labels, in plain Python.

It stands in for a full linguistic analyser: anything that fills the same token table can replace it (see
operators.analysis). Parts of speech come from closed-class words and suffixes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Closed-class words by part of speech.
CLOSED = {
    "determiner": ["a", "an", "the", "this", "that", "these", "those", "each", "every", "any", "all", "some", "no", "its", "their", "his", "her", "my", "our", "your"],
    "preposition": ["about", "after", "against", "at", "before", "between", "by", "during", "for", "from", "in", "into", "of", "off", "on", "over", "per", "through", "under", "until", "via", "with", "within", "without"],
    "conjunction": ["and", "or", "but", "nor", "if", "whether", "while", "because", "although", "when", "whereas", "otherwise"],
    "modal": ["can", "could", "may", "might", "must", "shall", "should", "will", "would"],
    "particle": ["to", "not"],
    "pronoun": ["i", "you", "he", "she", "it", "we", "they", "him", "them", "who", "which"],
    "auxiliary": ["be", "is", "are", "was", "were", "been", "being", "has", "have", "had", "do", "does", "did"],
    "adverb": ["then", "afterwards", "afterward", "subsequently", "thus", "meanwhile", "once", "again", "also", "first", "finally", "optionally"],
}
#: Verbs that open labels often; other words are verbs by suffix or by their place.
VERBS = ["accept", "add", "analyze", "approve", "archive", "assess", "assign", "calculate", "cancel", "change", "check", "close", "collect", "complete", "confirm", "contact", "create", "decide", "define", "deliver", "determine", "evaluate", "examine", "execute", "fill", "get", "give", "handle", "identify", "inform", "inspect", "issue", "make", "notify", "order", "pay", "perform", "pick", "plan", "prepare", "process", "provide", "receive", "record", "register", "reject", "repair", "report", "request", "review", "schedule", "select", "send", "ship", "sign", "store", "submit", "suggest", "take", "test", "transfer", "transmit", "update", "validate", "verify", "write"]
#: Suffixes of nouns that name an action, with the ending of the verb.
ACTION_SUFFIXES = [("ission", "it"), ("ification", "ify"), ("isation", "ise"), ("ization", "ize"), ("ation", "ate"), ("ection", "ect"), ("uction", "uce"), ("ution", "ute"), ("ition", "it"), ("etion", "ete"), ("ment", ""), ("ance", ""), ("ery", "er"), ("al", "e")]
#: Irregular forms.
IRREGULAR = {"sent": "send", "made": "make", "given": "give", "gave": "give", "taken": "take", "took": "take", "paid": "pay", "written": "write", "wrote": "write", "got": "get", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "has": "have", "had": "have", "does": "do", "did": "do", "people": "person", "men": "man", "women": "woman", "children": "child"}

_POS = {w: pos for pos, words in CLOSED.items() for w in words}
_VERBS = frozenset(VERBS)
_TOKEN = re.compile(r"\w+(?:[-']\w+)*|[^\w\s]")
_BREAK = re.compile(r"(?<=[.!?])\s+|\n+")


@dataclass
class Token:
    id: int
    form: str
    lemma: str
    pos: str
    begin: int
    end: int
    vform: str | None = None
    role: str | None = None
    is_head: bool = False
    is_predicate: bool = False
    in_condition: bool = False


def stem(word: str) -> str:
    """A lemma by suffix: plurals and verb endings."""
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    for end, put in (("ies", "y"), ("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("shes", "sh")):
        if w.endswith(end) and len(w) > len(end) + 1:
            return w[: -len(end)] + put
    if w.endswith("s") and len(w) > 3 and w[-2] not in "sui":
        w = w[:-1]
    for end in ("ing", "ed"):
        if w.endswith(end) and len(w) > len(end) + 2 and re.search("[aeiouy]", w[: -len(end)]):
            root = w[: -len(end)]
            for verb in (root, root + "e", root[:-1] if len(root) > 2 and root[-1] == root[-2] else root, root[:-1] + "y"):
                if verb in _VERBS:
                    return verb
            return root if end == "ed" else w
    return w


def tokenise(sentence: str) -> list[Token]:
    out: list[Token] = []
    for n, m in enumerate(_TOKEN.finditer(sentence)):
        word, low = m[0], m[0].lower()
        lemma, vform = stem(word), None
        if not word[0].isalnum() and word[0] != "_":
            pos, lemma = "punctuation", word
        elif low in _POS:
            pos = _POS[low]
        elif low.isdigit():
            pos = "number"
        elif lemma in _VERBS:
            before = next((t for t in reversed(out) if t.pos != "adverb"), None)
            pos = "noun" if before and before.pos == "determiner" else "verb"
        elif low.endswith("ly"):
            pos = "adverb"
        else:
            pos = "noun"
        if pos == "verb":
            vform = "participle" if low.endswith(("ed", "ing")) else "infinitive" if low == lemma else "personal"
        out.append(Token(n, word, lemma, pos, m.start(), m.end(), vform, is_predicate=pos == "verb"))
    return out


def annotate(tokens: list[Token]) -> list[Token]:
    """Roles around the predicates (A0 before, or A1 if passive, A1 after, the last noun of a phrase as head) and conditional clauses (from if to the comma)."""
    for n, t in enumerate(tokens):
        if t.is_predicate:
            passive = t.vform == "participle" and t.form.lower().endswith("ed") and any(x.lemma == "be" for x in tokens[max(0, n - 3) : n])
            for role, run in (("A1" if passive else "A0", _phrase(tokens, n - 1, -1)), ("A1", _phrase(tokens, n + 1, 1))):
                nouns = [x for x in run if x.pos in ("noun", "pronoun")]
                for x in run:
                    x.role = x.role or role
                if nouns:
                    nouns[-1].is_head = True
    inside = False
    for t in tokens:
        if t.form.lower() in ("if", "whether"):
            inside = True
        elif inside and t.form in (",", ";", ".", ":") or t.form.lower() == "then":
            inside = False
        elif inside:
            t.in_condition = True
    return tokens


def _phrase(tokens: list[Token], at: int, step: int) -> list[Token]:
    run = []
    while 0 <= at < len(tokens) and tokens[at].pos in ("noun", "determiner", "number", "pronoun", "auxiliary", "adverb", "modal"):
        if tokens[at].pos not in ("auxiliary", "adverb", "modal"):
            run.append(tokens[at])
        elif step > 0:
            break
        at += step
    return run if step > 0 else run[::-1]


def split_sentences(text: str) -> list[tuple[int, str]]:
    """(begin, sentence) of the non-blank sentences."""
    out, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        piece = text[at : m.start() if m else len(text)]
        if piece.strip():
            out.append((at + len(piece) - len(piece.lstrip()), piece.strip()))
        at = m.end() if m else at
    return out


def clean_label(label: str) -> str:
    return label.replace("\n", " ").strip(" \t\r.;")


@dataclass
class Label:
    """What a label says: predicates (two for "check and suggest updates"), object and complement words, heads last."""

    kind: str
    predicates: list[str] = field(default_factory=list)
    object: list[Token] = field(default_factory=list)
    complement: list[Token] = field(default_factory=list)
    tokens: list[Token] = field(default_factory=list)


def action_of(noun: str) -> str | None:
    """The verb of an action noun: transmission -> transmit."""
    for end, put in ACTION_SUFFIXES:
        if noun.endswith(end) and len(noun) > len(end) + 1:
            root = noun[: -len(end)]
            for verb in (root + put, root + put + "e", root):
                if verb in _VERBS:
                    return verb
    return noun if noun in _VERBS else None


def parse_label(label: str, kind: str = "task") -> Label:
    """Rules in order: double action, action, noun action (with of, or as the last noun), noun phrase."""
    words = [w.lower() if w[:1].isupper() and not any(c.isupper() for c in w[1:]) else w for w in clean_label(label).split(" ")]
    tokens = tokenise(" ".join(words))
    if kind == "task" and tokens and tokens[0].pos in ("noun", "verb") and (tokens[0].lemma in _VERBS or len(tokens) > 1 and tokens[1].pos == "determiner"):
        tokens[0].pos, tokens[0].vform, tokens[0].is_predicate = "verb", "infinitive", True
    out = Label("noun-phrase", tokens=tokens)
    if not tokens:
        return Label("empty")
    content = [t for t in tokens if t.pos != "punctuation"]
    cut = next((i for i, t in enumerate(content) if i and t.pos == "preposition"), len(content))
    head, tail = content[:cut], content[cut + 1 :]
    if head and head[0].is_predicate:
        out.kind, out.predicates, rest = "action", [head[0].lemma], head[1:]
        if len(rest) >= 2 and rest[0].pos == "conjunction" and (rest[1].lemma in _VERBS or rest[1].is_predicate):
            rest[1].pos, rest[1].is_predicate = "verb", True
            out.kind, out.predicates, rest = "double-action", [head[0].lemma, rest[1].lemma], rest[2:]
        for t in (*rest, *tail):  # after the verb, words that could be one are its object
            if t.pos == "verb":
                t.pos, t.vform, t.is_predicate = "noun", None, False
        out.object, out.complement = [t for t in rest if t.pos in ("noun", "number")], [t for t in tail if t.pos == "noun"]
        if not out.object:
            out.object, out.complement = out.complement, []
    else:
        nouns = [t for t in head if t.pos == "noun"]
        verb = action_of(nouns[-1].lemma) if nouns else None
        if verb:
            out.kind, out.predicates = "noun-action", [verb]
            of = cut < len(content) and content[cut].form == "of"
            out.object = [t for t in tail if t.pos == "noun"] if of else nouns[:-1]
            out.complement = [] if of else [t for t in tail if t.pos == "noun"]
        else:
            out.object = nouns
    for t in out.object:
        t.role = "A1"
    if out.object:
        out.object[-1].is_head = True
    return out
