"""Plain versions of the name operators, one text after the other, on Python's regular expressions."""

from __future__ import annotations

import hashlib
import re

from quillmesh.functions import keep_lists as K
from quillmesh.operators import spans as S


def compiled(p: S.Pattern) -> re.Pattern:
    return re.compile(p.groups(r"\b", r"\b", r"\s"))


def person_spans(text: str) -> list[tuple[int, int, str, str]]:
    found: dict[tuple[int, int], tuple[int, int, str, str]] = {}
    for p in S.PERSON:
        for m in compiled(p).finditer(text):
            name = m[2]
            if name not in K.GATE_NON_NAMES and not all(w in K.GATE_NON_NAMES for w in name.split()):
                found.setdefault(m.span(2), (*m.span(2), name, p.name))
    return sorted(found.values(), key=lambda s: (s[0], -s[1]))


def rewrite(text: str) -> tuple[str, int]:
    keep = S.Keep()
    every, anchors = set(keep.every()), set(keep.anchors())
    n = 0
    for p in S.PASSES:
        out, at = [], 0
        for m in compiled(p).finditer(text):
            name = m[2]
            words = name.split()
            stay = any(w in keep.canonical for w in words) or name in every or words[0] in anchors
            if p.name == "two_word":
                before = re.search(r"\b([A-Z][a-z]+|[A-Z]{2,})\s*$", text[: m.start()])
                after = re.match(r"\s+([A-Z][a-z]+)", text[m.end() : m.end() + 50])
                stay = stay or any(w in every for w in words) or (before and before[1] in anchors) or (after and after[1] in keep.institutions)
            if p.name == "bare_single":
                stay = stay or not re.search(r'[a-z,"”(]$', text[: m.start()])
            role = S.ROLES[int.from_bytes(hashlib.sha256(f"{S.SEED}:{name.lower()}".encode()).digest()[:4], "big") % len(S.ROLES)]
            new = {"particle": f"{m[1].split()[0]} {role}" if m[1].split() else role, "title": role, "two_word": role}.get(p.name, m[1] + role)
            out += [text[at : m.start()], m[0] if stay else new + m[3]]
            at = m.end()
            n += not stay
        text = "".join(out) + text[at:]
    return re.sub(r"\s+([.,;:!?])", r"\1", re.sub(r"\s+", " ", text).strip()), n


FIXTURES = (
    "Sen. Reynaldo Marquez met Bikoy Advincula in Quezon City.", "Sinabi ni Lopez na si Juan Dela Cruz ay umalis, Torres, at kay Mayor Bantayan.",
    "The Presidential Communications Operations Office said so; Maricel Santos Regional Trial Court agreed.", "ayon kay Panganiban, (Robredo) at \"Bikoy\" ay narito ngayon",
    "Juan Stone Mary Field Anna Stone left. Pulse Asia and Marlow Stone Office opened.", "Vice President Jun \"Boy\" Abad Santos , Duterte , spoke", "Pero Walang Kahapon Today",
    "Las Pinas said. Dalmor said no. Estrada sabi oo.", "Érika Stone and Thaléa Brûlée met", "Mr. Ángel Stone", "no names at all", "", "Atty. Pimentel  ;  Gov Ada Lovelace !",
    "we hear Bikoy Marlow spoke, says the note", "Candidate A met Candidate Zed and The President", "X" * 300 + " Ana Cruz " * 300,
)
