"""Personal information in free text -> typed mentions and redacted text.

High-recall generators propose overlapping spans of each kind; boosted trees score every span by its format
and its context; calibrated thresholds select spans, and of overlapping ones the longest among the sure (scores
above 0.9) is taken first, then the rest by score.  The trees are fitted on a bounded sample whose labels come from the audit log (placeholder and
original of each redaction) and from strong context words; spans without such evidence stay unlabelled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .lookalikes import targets_of
from .sampling import lowest_hashes

KINDS = ["email", "phone", "name", "address", "identity"]
TEXT_FIELD, LOG_FIELD = "redacted_cv.text", "redaction.original"
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "name": "[NAME]", "address": "[ADDRESS]", "identity": "[ID]"}
#: Bound of the training sample: CV texts and audit log rows (lowest hash of the id first).
SAMPLE_TEXTS, SAMPLE_LOG = 2500, 16000
_UP, _LOW = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽ", "a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĵķĺļľŀłńņňŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżž"
_L = _UP + _LOW

# Context words, accents folded, by what they speak of.
CONTEXT = {
    "phone": r"\b(?:tel|telefon\w*|phone|mobile?|mobil\w*|cell|gsm|handy|fax|call|reach|ring|volejte|volat|zavolejte|volajte|cislo|number|erreichbar|anrufen|rufen|appeler|joindre|llam\w+|telefono|movil|portable|nummer|numero|whatsapp|signal|t|m)\b",
    "identity": r"\b(?:rodne|rodnym|r\. ?c|rc|pojisten\w+|poistenc\w+|ssn|social security|national insurance|nino|ni number|insurance n\w+|passport|pas\b|pasu|cestovni\w*|reisepass|passeport|pasaporte|personal number|personalausweis\w*|document number|idnr|id ?nr|steuer\w*|tax|sozialversicherung\w*|sv-nummer|versichertennummer|rentenversicherung\w*|securite sociale|secu|nir|nif|nie|dni|seguridad social|fiscal\w*|tin|dic|obcansk\w+|op c|id card|identity|identi\w+)\b",
    "number": r"(?:#|\b(?:contract\w*|smlouv\w*|smluv\w*|zmluv\w*|vertrag\w*|contrat|contrato|invoice\w*|faktur\w*|facture|factura|rechnung\w*|order\w*|objednavk\w*|bestellung\w*|commande|pedido|ticket\w*|tique\w*|pozadav\w+|poziadav\w+|anfrage|version\w*|verz\w+|release\w*|modul\w*|module|node|iso|budget\w*|rozpoc\w+|presupuesto|ico|ic|reg|project\w*|projekt\w*|proyecto|build|issue|case|dr-?)\b)",
    "money": r"(?:[€$£]|\b(?:eur\w*|kc|czk|usd|gbp|million|thousand)\b)",
    "address": r"\b(?:adres\w+|address\w*|adresse|anschrift|direccion|bydl\w+|byva\w*|live|living|wohn\w*|habit\w+|vivo|domicil\w*|posted?|post|posilejte|posielajte|zasilejte|senden|schicken|envoy\w+|enviar|sidl\w+|residence|residing|ulic\w+|strasse|rue|calle)\b",
    "person": r"\b(?:manager|vedouci|nadrizen\w*|nadriaden\w*|kolega|kolegyne|kolegu|colleague|supervis\w+|vorgesetzte\w*|kollege|kollegin|betreu\w+|responsable|collegue|jefe|jefa|companer\w+|mentor\w*|reference|referenc\w+|recommend\w*|doporuc\w+|odporuc\w+|zastitil\w*|by|was|was also|era|etait|byl|byla|bol|bola|war|frau|herr|mr|mrs|ms|pan|pani|name|jmeno|meno|nom|nombre|contact|kontakt)\b",
    "company": r"\b(?:spolecnost\w*|spolocnost\w*|firm\w*|compan\w+|lieferant\w*|supplier|dodavatel\w*|fournisseur|proveedor|empresa|societe|client|klient\w*|kund\w+|with|zusammen mit|project\w*|projekt\w*|team|tym)\b",
}
_CONTEXT = {k: re.compile(v) for k, v in CONTEXT.items()}
_COMPANY = r"(?:s\.? ?r\.? ?o|a\.? ?s\b|spol|gmbh|ag\b|kg\b|ltd|llc|inc|plc|sarl|s\.?a\.?\b|s\.?l\.?\b|group|labs|bank|health|energy|logistics|retail|analytics|data|und partner|& co|partners|holding|consulting|solutions|software|systems|technologies|team|project|platform)"
_COMPANY_RIGHT = re.compile(rf"^[ ,]*(?:&|und\b|and\b(?= [A-Z])|{_COMPANY})", re.I)
_STREET = re.compile(
    r"(?:stra(?:ss|ß)e|str\.|weg|allee|gasse|platz|ring|damm|ufer|hof|\b(?:st|street|road|rd|avenue|ave|av|avda|lane|ln|drive|dr|close|row|mews|court|ct|way|bend|terrace|crescent|square|hill|place|blvd|boulevard|rue|allee|chemin|impasse|quai|cours|place|calle|c/|plaza|paseo|camino|ronda|travesia|carrer|ulice|ul|trida|namesti|nam|nabrezi|na|u|k|ke|pod|nad|v|ve|za|pri|am|an|im|auf|hinter|zum|zur|der)\b)", re.I)
_BIS = r"(?:[a-dA-D]\b|\s?(?:bis|ter)\b)?"
_CAPW = rf"(?:[{_UP}][{_L}'’.-]*|\d{{1,2}}\.)"
_LINK = r"(?:de la|de los|de las|del|de|des|du|la|le|les|der|den|dem|die|und|of|the|aux?|od|u)"
_CAPNAME = rf"(?:[{_UP}][{_LOW}]+(?:[-’'][{_UP}]?[{_LOW}]+)*|[{_UP}]{{2,}}(?:[-’'][{_UP}]{{2,}})*|[DO][’'][{_UP}][{_LOW}]+)"
#: What every form of an email has between name and host; tested before the generator, which is slow.
_MAYBE_EMAIL = re.compile(r"@| at |[\[({] ?(?:at|zavin|arroba|arobase)", re.I)
GENERATORS: list[tuple[str, re.Pattern]] = [
    ("email", re.compile(r"(?<![\w.+@-])[\w][\w.+%-]*(?: ?@ ?| ?(?:\[|\(|\{) ?(?:at|zavinac|zavináč|arroba|arobase) ?(?:\]|\)|\}) ?| at (?=[\w-]+(?:\.\w| dot |[\[({ ]+dot)))[\w-]+(?:(?:\.| ?[\[({] ?(?:dot|tecka|tečka|punkt|point|punto) ?[\])}] ?| dot )[\w-]+)*(?<![-.])", re.I)),
    ("phone", re.compile(r"(?<![\w.,/#+-])(?:\(?(?:\+|00)\d{1,3}\)?[ .\-/]?)?(?:\(0?\d{1,4}\)[ .\-/]?)?\d{1,5}(?:[ .\-/]\d{1,8}){0,6}(?![\w])")),
    ("phone", re.compile(r"(?<![\w+])(?:\(?\+\d{1,3}\)?|\(\d{2,4}\))[ .\-/]?(?:\(0\)[ .\-/]?)?\d{2,12}(?:[ .\-/]\d{1,8}){0,6}(?!\w)")),
    ("phone", re.compile(r"(?<![\w.,/#+-])\d{8,13}(?!\w)")),
    ("identity", re.compile(r"(?<![\w.,#-])\d{6} ?/ ?\d{3,4}(?!\w)")),
    ("identity", re.compile(r"(?<![\w.,/#-])\d{9,11}(?![\w/])")),
    ("identity", re.compile(r"(?<![\w.,/#-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w-])")),
    ("identity", re.compile(r"(?<![\w.,/#-])[A-Z]{1,2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z](?!\w)")),
    ("identity", re.compile(r"(?<![\w.,/#-])[A-Z]{1,2}\d{6,9}[A-Z]?(?!\w)")),
    ("identity", re.compile(r"(?<![\w.,/#-])(?:[XYZ][- ]?)?\d{7,8}[- ]?[A-Z](?!\w)")),
    ("identity", re.compile(r"(?<![\w.,/#-])\d{2,3}(?:[ ./-]\d{2,4}){2,4}(?![\w/])")),
    ("identity", re.compile(r"(?<![\w.,/#-])[12] ?\d{2} ?\d{2} ?\d[\dAB] ?\d{3} ?\d{3}(?: ?\d{2})?(?!\w)")),
    ("identity", re.compile(r"(?<![\w.,/#-])\d{2} ?\d{6} ?[A-Z] ?\d{3}(?!\w)")),
    ("address", re.compile(rf"(?<![\w/.-])\d{{1,4}}{_BIS},? (?:(?:{_LINK}|rue|avenue|allée|allee|boulevard|place|chemin|impasse|quai|cours|route|square) )*{_CAPW}(?: (?:{_LINK} )?{_CAPW}){{0,3}}(?:\b|(?<=\.))")),
    ("name", re.compile(rf"(?<![\w@.'’-])(?:{_CAPNAME}|[{_UP}]\.)(?:[ ]?(?<=\.)|[ ])(?:[{_UP}]\. ?)?{_CAPNAME}(?![\w@])")),
    ("name", re.compile(rf"(?<![\w@.'’-]){_CAPNAME} (?:{_CAPNAME}|[{_UP}]\.|von|van|de|del|der) {_CAPNAME}(?![\w@])")),
    ("name", re.compile(rf"(?<![\w@.'’-]){_CAPNAME}, (?:{_CAPNAME}|[{_UP}]\.)(?![\w@])")),
]
_NUMBER_END = re.compile(rf"(?<=[{_L}.’'])(?:, ?| )(?:č\. ?|nº ?|no\. ?|Nr\. ?)?\d{{1,4}}(?:/\d{{1,4}})?{_BIS}(?![\w/])")
_WORD_BEFORE = re.compile(rf"(?:C/|[{_L}][{_L}.’'-]*|\d{{1,2}}\.)$")
_TITLE = re.compile(r"^(?:(?:Ing|Mgr|Bc|Dr|Prof|Doc|MUDr|JUDr|RNDr|PhDr|PaedDr|MgA|Dipl|Mr|Mrs|Ms|Miss|Herr|Frau|Pan|Paní|Pani|Sr|Sra|Mme|Mlle|Don|Doña|arch|Kolega|Kolegyně)(?:\. ?| ))+")
_LEADING_SIGN = re.compile(r"[A-Za-z]")
_UNSTABLE = re.compile(rf"[^\x20-\x7e\n\t{_L}§°·•–—’‘“”„…€£]")


def folded(text: str) -> tuple[str, list[int] | None]:
    """Text with look-alikes in one form, and per position its place in the original (None: the same places)."""
    if not _UNSTABLE.search(text):
        return text, None
    out: list[str] = []
    place: list[int] = []
    done = 0
    for m in _UNSTABLE.finditer(text):
        i = m.start()
        out.extend(text[done:i])
        place.extend(range(done, i))
        done = i + 1
        if unicodedata.combining(c := text[i]) and out:
            whole = unicodedata.normalize("NFC", out[-1] + c)
            if len(whole) == 1:
                out[-1] = whole
                continue
        for x in unicodedata.normalize("NFC", _target(c)):
            out.append(x)
            place.append(i)
    out.extend(text[done:])
    place.extend(range(done, len(text)))
    return "".join(out), place + [len(text)]


@lru_cache(maxsize=4096)
def _target(c: str) -> str:
    return targets_of(c)


class _Plain(dict):
    """Character -> its lower-case base letter, filled as characters occur."""

    def __missing__(self, code: int) -> str:
        base = unicodedata.normalize("NFD", chr(code))[0].lower()
        self[code] = base = base if len(base) == 1 else chr(code)
        return base


_PLAIN = _Plain()


def plain(text: str) -> str:
    """Lower case without accents, one character for one."""
    return text.lower() if text.isascii() else text.translate(_PLAIN)


def _address_spans(text: str):
    """Street then number: every start among the words before a number, back to four words."""
    for m in _NUMBER_END.finditer(text):
        at, words = m.start(), 0
        end = m.end()
        line = text.rfind("\n", 0, at) + 1
        while words < 5 and at > line and (w := _WORD_BEFORE.search(text[line:at])):
            start = line + w.start()
            words += 1
            if text[start].isupper() or text[start:at] in ("ulice", "ul.", "třída", "rue", "calle"):
                yield start, end
            if start == line or text[start - 1] != " ":
                break
            at = start - 1


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans (kind, start, end); they may overlap and be of several kinds."""
    out = set()
    for kind, rx in GENERATORS:
        if kind == "email" and not _MAYBE_EMAIL.search(text):
            continue
        at = 0
        while m := rx.search(text, at):
            s, e = m.span()
            at = max(s + 1, m.end()) if kind != "name" else s + max(1, len(text[s:e].split(" ")[0]))
            if kind == "phone" and not 7 <= sum(c.isdigit() for c in text[s:e]) <= 15:
                continue
            if kind == "name":
                s += len(_TITLE.match(text[s:e])[0]) if _TITLE.match(text[s:e]) else 0
                if " " not in text[s:e] and "." not in text[s:e]:
                    continue
            out.add((kind, s, e))
    out |= {("address", s, e) for s, e in _address_spans(text)}
    return sorted(out)


_SHAPES = [re.compile(x) for x in (
    r"\(?\+\d", r"\(?00\d{2}", r"\(\d{3}\) ?\d{3}-\d{4}", r"(?:1-)?\d{3}-\d{3}-\d{4}$", r"\d{3}[. ]\d{3}[. ]\d{3}$", r"0\d(?:[ .]\d\d){4}$", r"0\d{2,4}[ /-]\d", r"[1-9]\d{8}$", r"0\d{8,11}$",
    r"\d{6} ?/ ?\d{3,4}$", r"\d{10}$", r"\d{3}-\d{2}-\d{4}$", r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]$", r"[A-Z]{1,2}\d{6,9}$", r"\d{2} \d{3} \d{3} \d{3}$", r"[12] ?\d\d ?\d\d ?\d[\dAB] ?\d{3} ?\d{3}", r"[XYZ]?-?\d{7,8}-?[A-Z]$", r"756\.\d{4}\.\d{4}\.\d{2}$",
    r"\d{1,2}\.\d{1,3}\.\d{1,4}$", r"\d{1,3}(?:[ .]\d{3})+$", r"(?:19|20)\d\d\D+(?:19|20)\d\d$", r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}$", r"\d{5,}-\d{1,3}$", r"\d{4}-\d{3}-\d{3}$", r"\d{4}-\d\d - \d{4}-\d\d$", r"\d{1,3}(?:\.\d{1,3}){3}$", r"\d{2} \d{6} [A-Z] \d{3}$",
)]


def _birth_number(digits: str) -> float:
    """2: a birth number whose date is valid and that divides by 11; 1: date valid; 0: neither."""
    if len(digits) not in (9, 10):
        return 0.0
    mm, dd = int(digits[2:4]), int(digits[4:6])
    if not (1 <= dd <= 31 and any(1 <= mm - x <= 12 for x in (0, 20, 50, 70))):
        return 0.0
    return 2.0 if len(digits) == 10 and int(digits) % 11 == 0 else 1.0


def _letter_check(v: str) -> float:
    d = re.sub(r"\D", "", v)
    return float(len(d) in (7, 8) and v[-1:].isalpha() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(d) % 23] == v[-1])


class Lexicon:
    """What the sample's audit log says of the words in names: first names go with many surnames and the reverse."""

    def __init__(self, names: list[str], texts: list[str]):
        after, before = defaultdict(set), defaultdict(set)
        for n in names:
            w = [x for x in re.split(r"[ ,]+", _TITLE.sub("", n)) if len(x) > 2 and x[-1] not in ".:"]
            if len(w) == 2:
                after[plain(w[0])].add(plain(w[1]))
                before[plain(w[1])].add(plain(w[0]))
        self.first = {k: len(v) for k, v in after.items() if len(v) >= 3}
        self.last = {k: len(v) for k, v in before.items() if len(v) >= 2 and k not in self.first}
        good, bad = Counter(), Counter()
        for k in list(self.last) + [s for f in self.first for s in after[f]]:
            good.update(self._grams(k))
        for t in texts:
            for w in re.findall(rf"[{_UP}][{_LOW}]{{2,}}", t):
                w = plain(w)
                if w not in self.first and w not in self.last:
                    bad.update(self._grams(w))
        g, b = sum(good.values()) + 1, sum(bad.values()) + 1
        self.odds = {k: float(np.log((good[k] + 0.5) / g) - np.log((bad[k] + 0.5) / b)) for k in set(good) | set(bad)}

    @staticmethod
    def _grams(w: str):
        w = f"^{w}$"
        return [w[i: i + 3] for i in range(len(w) - 2)] + [w[-4:]]

    def surname(self, w: str) -> float:
        gs = self._grams(w)
        return sum(self.odds.get(x, 0.0) for x in gs) / len(gs)


def features(text: str, low: str, lex: Lexicon, kind: str, s: int, e: int, whole: bool, contexts: dict | None = None) -> list[float]:
    """Format and context of one span; the same columns for every kind.  contexts: what stands before a place, kept per text."""
    v = text[s:e]
    digits = re.sub(r"\D", "", v)
    line_s = text.rfind("\n", 0, s) + 1
    line_e = text.find("\n", e)
    line_e = len(text) if line_e < 0 else line_e
    left, near = low[max(line_s, s - 48): s], low[max(line_s, s - 16): s]
    right = low[e: min(line_e, e + 24)]
    groups = re.findall(r"\d+", v)
    out = [float(whole), float(s == line_s), float(e == line_e), float(line_e - line_s), min(6.0, float(text.count("\n", 0, min(s, 4000)))), float(len(v)), (e - s) / max(1, line_e - line_s), float("[" in text[line_s:line_e])]
    out += [float(len(digits)), float(len(groups)), float(len(groups[0]) if groups else 0), float(len(groups[-1]) if groups else 0), float(v[:1] == "0"), float(digits[:1] or 0), float(v.count(" ")), float(sum(c.isalpha() for c in v))]
    # The shapes are of numbers; names and email addresses have none of them.
    out += [0.0] * len(_SHAPES) if kind in ("name", "email") else [float(p.match(v) is not None) for p in _SHAPES]
    out += [_birth_number(digits), _letter_check(v)]
    before = contexts.get(s) if contexts is not None else None
    if before is None:
        before = []
        for p in _CONTEXT.values():
            # What stands near also stands in the wider context.
            far = p.search(left) is not None
            before += [float(far), float(far and p.search(near) is not None)]
        if contexts is not None:
            contexts[s] = before
    out += before
    out += [float(bool(_CONTEXT["money"].match(right.lstrip()))), float(right[:2] == " %"), float(bool(re.match(r",? (?:\d{3} ?\d{2}|\d{4,5}) [a-z]", right))), float(bool(_COMPANY_RIGHT.match(text[e: e + 24]))), float(left.rstrip()[-1:] == "&"), float(left.rstrip()[-1:] in (":", ".")), float(right[:1] in ("-", "/", "."))]
    if kind == "name":
        w = [plain(x) for x in re.split(r"[ ,]+", v) if x]
        full = [x for x in w if x[-1] != "."]
        scores = [lex.surname(x) for x in full]
        first = [float(x.split("-")[0] in lex.first or x in lex.first) for x in full]
        last = [float(x in lex.last or x.split("-")[-1] in lex.last) for x in full]
        not_first = [sc for sc, f in zip(scores, first) if not f] or [-1.0]
        out += [float(len(w)), float(len(full)), first[0], first[-1], sum(first), last[0], last[-1], sum(last), scores[0], scores[-1], max(not_first), min(not_first), float("," in v), float(sum(x.isupper() and len(x) > 2 for x in re.split(r"[ ,-]+", v))), float(len(w) - len(full))]
        out += [float(bool(re.match(r" (?:[A-Z]\. )?[A-ZÀ-Ž]", text[e: e + 4]))), float(bool(re.search(r"[A-ZÀ-Ž][\w'-]*\.? $", text[max(line_s, s - 14): s])))]
    else:
        out += [0.0] * 17
    if kind == "address":
        w = plain(v).split()
        out += [float(bool(_STREET.search(plain(v)))), float(v[:1].isdigit()), float(len(w)), float(bool(re.search(r"(?:19|20)\d\d$", v))), float("." in v), float(bool(re.search(r"\d/\d", v))), float(bool(re.search(r"\d[a-d]\b|bis|ter\b", v))), float(any(x in _MONTHS for x in w)), float(bool(re.match(r"(?:na|u|k|ke|pod|nad|v|za|am|an|hinter|im|auf|zum|zur)\b", plain(v)))), float(bool(re.search(rf"[{_UP}][{_L}.]+ $", text[max(line_s, s - 14): s]))), float(bool(re.match(rf"(?: \d\d)? [{_UP}]", text[e: e + 5]))), float(bool(re.search(r", ?\d{3,5}$", v))), float(v.count(","))]
    else:
        out += [0.0] * 13
    return out


_MONTHS = set("january february march april may june july august september october november december januar februar marz mai juni juli oktober dezember jan feb mar apr jun jul aug sep sept oct nov dec version module project iso python java".split())


def weak_label(text: str, low: str, lex: Lexicon, kind: str, s: int, e: int, whole: bool, log_kind: str | None) -> int | None:
    """1 or 0 where evidence is strong, else None."""
    v = text[s:e]
    digits = re.sub(r"\D", "", v)
    line_s = text.rfind("\n", 0, s) + 1
    near, left, right = low[max(line_s, s - 22): s], low[max(line_s, s - 48): s], low[e: e + 20]
    numbered = bool(_CONTEXT["number"].search(near)) or text[s - 1: s] in ("#", "-")
    birth = _birth_number(digits)
    nino = bool(re.match(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]$", v))
    if kind == "email":
        host = re.split(r"@|\bat\b|zavin\w+", v)[-1]
        dotted = bool(re.search(r"\.|dot|te[cč]ka|punkt|punto|point", host))
        return int(dotted and (("@" in v) or bool(re.search(r"[\[({]\s?(?:at|zavin|arro|aro)", v)) or " dot " in v))
    if kind == "phone":
        if numbered or re.match(r" ?(?:eur|kc|€|\$|£|czk|million|%)", right) or (birth and "/" in v) or re.match(r"\d{3}-\d\d-\d{4}$|\d{5,}[/-]\d+$|\d{1,2}\.\d{1,3}\.\d{1,4}$|\d{1,3}(?:\.\d{1,3}){3}$|\d{4}-\d{3}-\d{3}$", v):
            return 0
        if re.search(r"(?:19|20)\d\d\s*[-–/]\s*(?:19|20)\d\d|^\d{1,2}[./]\d{4}|^(?:19|20)\d\d[-/]\d\d?\b", v) or len(digits) < 8:
            return 0
        if _CONTEXT["identity"].search(near):
            return 0
        if re.match(r"[12] ?\d\d ?\d\d ?\d\d ?\d{3} ?\d{3}", v) or re.match(r"\d{2} \d{3} \d{3} \d{3}$", v) or (birth == 2 and len(digits) == 10):
            return 0
        if re.match(r"\(?(?:\+|00)\d|\(\d{3}\)|1-\d{3}-\d{3}-\d{4}", v) and 9 <= len(digits) <= 14:
            return 1
        if whole and log_kind == "phone" and re.match(r"\d{3}-\d{3}-\d{4}$|\d{3}[. -]\d{3}[. -]\d{3}$|0[\d /.()-]{8,14}$|[1-9]\d{8}$", v) and len(digits) >= 9:
            return 1
        if not whole and re.search(r"(?:tel|phone|mobile?|volejte|volajte|call|appeler|anrufen|llam\w+|cislo|number|nummer)\b[^\d]{0,28}$", left) and 9 <= len(digits) <= 13:
            return 1
        return 0 if v[:1] == "0" and len(groups := re.findall(r"\d+", v)) == 1 and len(groups[0]) == 9 else None
    if kind == "identity":
        if numbered and not _CONTEXT["identity"].search(near):
            return 0
        if re.match(r"\d{6} ?/ ?\d{3,4}$", v):
            return int(birth == 2 or (birth == 1 and bool(_CONTEXT["identity"].search(left))))
        if nino or re.match(r"[12] ?\d\d ?\d\d ?\d[\dAB] ?\d{3} ?\d{3} ?\d{2}$", v) or (re.match(r"\d{3}-\d{2}-\d{4}$", v)) or re.match(r"\d{2} \d{6} [A-Z] \d{3}$", v):
            return 1
        if _CONTEXT["identity"].search(near) and len(digits) >= 6 and not re.match(r"\(?\+|00", v):
            return 1
        if _CONTEXT["phone"].search(near) or re.match(r"0\d(?:[ .]\d\d){4}$|\d{3}-\d{3}-\d{4}|\d{3}[ .]\d{3}[ .]\d{3}$|(?:19|20)\d\d\D|\d{1,2}\.\d{1,3}\.\d{1,4}$", v):
            return 0
        if re.match(r"[A-Z]{1,2}\d{7,8}$", v) or _letter_check(v):
            return 1
        if re.match(r"\d{2} \d{3} \d{3} \d{3}$", v):
            return 1
        if re.match(r"\d{10}$", v):
            return int(birth == 2)
        return 0 if re.match(r"[1-9]\d{8}$", v) else None
    if kind == "address":
        if re.search(r"(?:19|20)\d\d$", v) and not whole or numbered or any(x in _MONTHS for x in plain(v).replace(",", " ").split()):
            return 0
        if re.search(r", ?\d{3,5}$", v) and re.match(r"(?: \d\d)? [a-z]", right) and not re.match(r"(?:Plaza|Calle|C/|Avda|Av\.|Paseo)", v):
            return 0
        extent = not re.match(r"(?:Adresa|Address|Adresse|Direcci[oó]n|Anschrift|Wohnung|Familie)\b|.*\bWohnung\b", v)
        if extent and low[max(0, s - 8): s] == "wohnung ":
            return 1
        starts = s == line_s or low[max(0, s - 2): s] == ": " or (whole and s == 0)
        postcode = re.match(r",? (?:\d{3} ?\d{2}|\d{4,5}) [a-z]", right) is not None
        if extent and starts and (postcode or (whole and log_kind == "address" and (e == len(text) or text[e] == ","))):
            return 1
        if postcode and not starts or not extent:
            return 0
        if re.search(r"(?:adres[ue]|adresse|address|posted to|at|direccion(?: de)?|en) $", left) and _STREET.search(plain(v)) and _CONTEXT["address"].search(left):
            return 1
        if re.search(r"(?:tel|phone|mobile?|ssn|idnr|no|ticket|faktur\w|iso|\bt)\.? $", left) or re.match(r"(?:Tel|Mobile?|SSN|T|IdNr|Ticket|Faktura|ISO|Passport|Rodn|National|[A-Z]{2,})\b", v):
            return 0
        return 0 if not _STREET.search(plain(v)) else None
    # names
    words = [plain(x) for x in re.split(r"[ ,]+", v) if x]
    full = [x for x in words if x[-1] != "."]
    first = [x.split("-")[0] in lex.first or x in lex.first for x in full]
    company = bool(_COMPANY_RIGHT.match(text[e: e + 24])) or left.rstrip().endswith("&") or bool(re.search(r"(?:spolecnost\w*|spolocnost\w*|supplier|lieferant|dodavatel|proveedor|fournisseur|empresa|project|projekt) $", left))
    if company or (text[e: e + 1] == " " and re.match(rf" (?:[{_UP}]\. )?{_CAPNAME}", text[e:]) and lex.surname(plain(re.split(r"[ ,\n]", text[e + 1: e + 30])[-2 if re.match(r" [A-Z]\. ", text[e:]) else 0])) > 0.4):
        return 0
    if not any(first):
        if len(words) > len(full) and len(full) == 1:
            return int(lex.surname(full[0]) > 0.6) if abs(lex.surname(full[0])) > 0.3 else None
        return 0 if max(lex.surname(x) for x in full) < 0.2 or not any(x in lex.last for x in full) else None
    rest = [x for x, f in zip(full, first) if not f]
    if not rest:
        return 0
    good = all(lex.surname(x) > 0 for x in rest)
    if "," in v:
        return int(good and first[-1] and not first[0])
    return int(good) if good or min(lex.surname(x) for x in rest) < -0.5 else None


class Detector:
    """Lexicon and one calibrated model a kind."""

    def __init__(self, texts: list[str], log: list[tuple[str, str]]):
        """texts: CV texts; log: (original, placeholder) of the audit log."""
        kind_of = {"[EMAIL]": "email", "[PHONE]": "phone", "[NAME]": "name", "[ADDRESS]": "address"}
        pairs = [(folded(o)[0], kind_of.get(r)) for o, r in log if o]
        self.lex = Lexicon([o for o, k in pairs if k == "name"], texts)
        rows: dict[str, list] = {k: [] for k in KINDS}
        for i, (text, k, whole) in enumerate([(folded(t)[0], None, False) for t in texts] + [(o, k, True) for o, k in pairs]):
            low, contexts = plain(text), {}
            for kind, s, e in spans_of(text):
                y = weak_label(text, low, self.lex, kind, s, e, whole, k)
                if y is not None:
                    rows[kind].append((features(text, low, self.lex, kind, s, e, whole, contexts), y, i))
        self.models: dict[str, BoostedTrees | None] = {}
        self.labelled = {}
        for kind, r in rows.items():
            if len({y for _, y, _ in r}) < 2:
                # Evidence of one sort only: no tree can be grown, every span goes the way of the evidence.
                self.models[kind] = BoostedTrees(trees=0).fit(np.zeros((2, 1)), np.ones(2)) if r and r[0][1] else None
                continue
            X, y, i = np.array([x for x, _, _ in r]), np.array([y for _, y, _ in r]), np.array([i for _, _, i in r])
            held = i % 4 == 0
            self.labelled[kind] = (int(y.sum()), int(len(y) - y.sum()))
            m = BoostedTrees().fit(X[~held], y[~held])
            self.models[kind] = m.calibrate(X[held], y[held])

    def mentions_batch(self, texts: list[str], whole: bool) -> list[list[tuple[str, int, int, float]]]:
        """Per text its mentions (kind, start, end, score); the spans of all texts are scored together."""
        kept: list[list] = [[] for _ in texts]
        forms, todo = [], {k: ([], []) for k in KINDS}
        for i, t in enumerate(texts):
            text, place = folded(t)
            forms.append((text, place))
            low, contexts = plain(text), {}
            for kind, s, e in spans_of(text):
                if self.models.get(kind) is not None:
                    todo[kind][0].append(features(text, low, self.lex, kind, s, e, whole, contexts))
                    todo[kind][1].append((i, s, e))
        for kind, (X, at) in todo.items():
            if X:
                m = self.models[kind]
                for p, (i, s, e) in zip(m.predict(np.array(X)), at):
                    if p >= m.threshold:
                        kept[i].append((round(float(p), 4), e - s, kind, s, e))
        out = []
        for (text, place), spans in zip(forms, kept):
            taken, chosen = [], []
            for p, _, kind, s, e in sorted(spans, key=lambda x: (-(x[0] > 0.9), -x[1] if x[0] > 0.9 else -x[0], -x[0], x[3])):
                if all(e <= a or s >= b for a, b in taken):
                    taken.append((s, e))
                    chosen.append((kind, s, e, p))
            if place is not None:
                chosen = [(k, place[s], _end(place, e), p) for k, s, e, p in chosen]
            out.append(sorted(chosen, key=lambda c: c[1]))
        return out


def _end(place: list[int], e: int) -> int:
    """Original end of a folded span: up to the next base character, without invisible ones behind."""
    last = place[e - 1]
    nxt = place[e]
    return max(last + 1, nxt)


def _trim(text: str, s: int, e: int) -> int:
    while e > s and (unicodedata.category(text[e - 1]) == "Cf" or text[e - 1].isspace()):
        e -= 1
    return e


def training_sample(cvs: DataFrame, log: DataFrame) -> tuple[list[str], list[tuple[str, str]]]:
    """Bounded sample for the fit only; the detector then runs over every whole text."""
    t = lowest_hashes(cvs, "cv_id", [(F.col("cv_id").isNotNull(), SAMPLE_TEXTS)]).where("text is not null").select("cv_id", "text").toPandas().drop_duplicates("cv_id").sort_values("cv_id")
    r = lowest_hashes(log, "redaction_id", [(F.col("redaction_id").isNotNull(), SAMPLE_LOG)]).where("original is not null").select("redaction_id", "original", "replacement").toPandas().drop_duplicates("redaction_id").sort_values("redaction_id")
    return t.text.tolist(), list(zip(r.original, r.replacement))


_WORKER: dict = {}


def _detector(bc) -> Detector:
    if _WORKER.get("bc") is not bc:
        _WORKER.update(bc=bc, d=bc.value)
    return _WORKER["d"]


def _find(bc):
    def run(batches):
        d = _detector(bc)
        for pdf in batches:
            out = []
            for field in (TEXT_FIELD, LOG_FIELD):
                part = pdf[pdf.field == field]
                texts = part.text.tolist()
                for rid, text, found in zip(part.rec_id, texts, d.mentions_batch(texts, field == LOG_FIELD)):
                    out += [(field, rid, k, text[s: _trim(text, s, e)], s, _trim(text, s, e), p) for k, s, e, p in found]
            yield pd.DataFrame(out, columns=["field", "rec_id", "kind", "mention", "start", "end", "score"])

    return run


def fit(cvs: DataFrame, log: DataFrame) -> Detector:
    return Detector(*training_sample(cvs, log))


def find_mentions(cvs: DataFrame, log: DataFrame) -> DataFrame:
    """(field, rec_id, kind, mention, start, end, score) in all CV texts and audit log originals.

    Null and empty texts give no row; redelivered log rows count once; spans are offsets into the text.
    """
    spark = cvs.sparkSession
    bc = spark.sparkContext.broadcast(fit(cvs, log))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    a = cvs.where("cv_id is not null and text <> ''").select(F.lit(TEXT_FIELD).alias("field"), F.col("cv_id").cast("long").alias("rec_id"), "text")
    b = log.where("redaction_id is not null and original <> ''").select(F.lit(LOG_FIELD).alias("field"), F.col("redaction_id").cast("long").alias("rec_id"), F.col("original").alias("text"))
    rows = a.unionByName(b).repartition(n, "rec_id").dropDuplicates(["field", "rec_id"])
    return rows.mapInPandas(_find(bc), "field string, rec_id long, kind string, mention string, start int, end int, score double")


def found_mentions(cvs: DataFrame, log: DataFrame) -> DataFrame:
    """p1: the distinct (field, rec_id, kind, mention)."""
    return find_mentions(cvs, log).select("field", "rec_id", "kind", "mention").distinct()


def redact_texts(cvs: DataFrame, log: DataFrame) -> DataFrame:
    """(cv_id, text, n_redactions): every mention replaced by its typed placeholder; null texts stay null."""
    spark = cvs.sparkSession
    bc = spark.sparkContext.broadcast(fit(cvs, log))

    def run(batches):
        d = _detector(bc)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf.text]
            out = []
            for k, raw, text, found in zip(pdf.cv_id, pdf.text, texts, d.mentions_batch(texts, False)):
                for kind, s, e, _ in reversed(found):
                    text = text[:s] + PLACEHOLDER[kind] + text[_trim(text, s, e):]
                out.append((k, text if isinstance(raw, str) else None, len(found)))
            yield pd.DataFrame(out, columns=["cv_id", "text", "n_redactions"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return cvs.select("cv_id", "text").repartition(n, "cv_id").mapInPandas(run, "cv_id long, text string, n_redactions int")
