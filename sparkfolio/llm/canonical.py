"""Free-entered values -> entries of a reference list, by a trie searched with a Levenshtein automaton.

The trie holds every way a reference entry may be written: its names in either language, with and without
accents, with each word replaced by its usual short forms (alias paths), and with the head word first.  A
value's core (what is left without seniority words, employer, city, skills and the like) is walked down
the trie; one row of the edit-distance automaton per trie level gives all entries within a distance that
depends on the core's length.  Values are matched once per distinct spelling.
"""

from __future__ import annotations

import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_rows

# Short forms and synonyms of words in titles, accents folded.
WORD_FORMS = {
    "engineer": "eng engr ing", "developer": "dev develop programmer", "analyst": "anlst anl analytic", "scientist": "sci scient",
    "administrator": "admin", "architect": "arch", "consultant": "cons consult", "machine learning": "ml", "database": "db",
    "software": "sw", "business": "biz bus", "financial": "fin finance", "marketing": "mktg mkt", "security": "sec cybersecurity",
    "backend": "back_end be", "frontend": "front_end fe", "devops": "dev_ops", "bi": "business_intelligence", "solutions": "solution sol",
    "test automation": "automation_test qa_automation", "research": "res", "product": "prod", "director": "dir", "head": "head_of",
    "inzenyr": "ing", "vyvojar": "programator", "spravce": "administrator admin", "analytics": "analytic",
}
# Words of seniority and the band they name.
BAND_WORDS = {
    "junior": "junior jr jnr jun graduate trainee",
    "mid": "mid middle medior regular",
    "senior": "senior sr snr sen",
    "staff": "staff principal princ",
}
_BAND_OF = {w: b for b, words in BAND_WORDS.items() for w in words.split()}
#: What follows a title and isn't part of it.
_TAIL = re.compile(r"\s*(?:\||\bat\b|@|\bu\b(?= [A-ZÁ-Ž])|\bve? (?=[A-ZÁ-Ž])|\bbei\b|\bchez\b|\bin\b|\s[–—]\s).*$|\((?:m|f|w|d|x|h|ž)(?:\s*/\s*(?:m|f|w|d|x|h|ž))+\)", re.I)
_YEARS = re.compile(r"[,;]?\s*\(?\b\d+\+?\s*(?:years?|yrs?|let|roky?|jahre?|ans|años|rokov)\b.*$", re.I)


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def allowed(n: int) -> int:
    """Edit distance allowed for a core of n characters."""
    return 0 if n < 5 else 1 if n < 12 else 2


class Trie:
    """Reference entries as paths; a node is [children, ids]."""

    def __init__(self):
        self.root: list = [{}, set()]

    def add(self, path: str, entry: int) -> None:
        node = self.root
        for c in path:
            node = node[0].setdefault(c, [{}, set()])
        node[1].add(entry)

    def search(self, word: str, limit: int) -> dict[int, int]:
        """Every entry within `limit` edits (insert, delete, replace, swap of neighbours) -> least distance."""
        found: dict[int, int] = {}
        first = list(range(len(word) + 1))
        if self.root[1] and first[-1] <= limit:
            found.update(dict.fromkeys(self.root[1], first[-1]))
        stack = [(c, node, first, None, "") for c, node in self.root[0].items()]
        while stack:
            c, node, row, above, before = stack.pop()
            new = [row[0] + 1]
            for i, w in enumerate(word, 1):
                d = min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (w != c))
                if above is not None and i > 1 and w == before and word[i - 2] == c:
                    d = min(d, above[i - 2] + 1)
                new.append(d)
            if new[-1] <= limit:
                for e in node[1]:
                    found[e] = min(found.get(e, 99), new[-1])
            if min(new) <= limit or min(row) < limit:
                stack += [(x, child, new, row, c) for x, child in node[0].items()]
        return found


def _forms(words: str) -> list[str]:
    """All spellings of an entry's words: each part as it is or by one of its short forms."""
    options, i, w = [], 0, words.split()
    while i < len(w):
        pair = " ".join(w[i: i + 2])
        key = pair if pair in WORD_FORMS else w[i]
        options.append([key, *(x.replace("_", " ") for x in WORD_FORMS.get(key, "").split())])
        i += 2 if key == pair and " " in pair else 1
    return list(itertools.product(*options))


def paths_of(name: str) -> set[str]:
    """Paths of an entry's name: every form, in the written order and with the last or first part moved to the other end."""
    words = re.sub(r"\bof\b", " ", fold(name))
    out = set()
    for parts in _forms(" ".join(words.split())):
        for order in {parts, parts[-1:] + parts[:-1], parts[1:] + parts[:1]}:
            out.add(" ".join(order))
            out.add("".join(" ".join(order).split(" ")))
    return out


def core_of(value: str) -> tuple[str, str | None]:
    """(core words, band word's band): the value without its tail and its words of seniority."""
    text = _YEARS.sub("", _TAIL.sub(" ", re.sub(r"[     ]", " ", value)))
    words = re.findall(r"[^\W_]+", re.sub(r"\bof\b", " ", fold(text)))
    band, core = None, []
    for w in words:
        b = _BAND_OF.get(w)
        if b is None and len(w) >= 5:
            b = next((_BAND_OF[x] for x in ("junior", "senior", "staff", "principal") if _near(w, x)), None)
        if b and band is None:
            band = b
        elif not b:
            core.append(w)
    return " ".join(core), band


def _near(a: str, b: str) -> bool:
    """At most one edit apart."""
    t = Trie()
    t.add(b, 1)
    return bool(t.search(a, 1)) and a[0] == b[0]


class Matcher:
    """The reference list as a trie of occupations, and the entry of each occupation and band."""

    def __init__(self, roles):
        self.trie, self.by_band, self.fixed = Trie(), {}, {}
        for role_id, canonical, band, management, title_cs in roles:
            names = [n for n in (canonical, title_cs) if n]
            if management:
                occupation = fold(canonical)
                self.fixed[occupation] = role_id
            else:
                bands = "|".join(b for words in BAND_WORDS.values() for b in words.split() if len(b) > 3)
                names = [re.sub(rf"^(?:{bands})\s+", "", fold(n)) for n in names]
                occupation = names[0]
                self.by_band.setdefault(occupation, {})[band] = role_id
            for n in names:
                for p in paths_of(n):
                    self.trie.add(p, occupation)

    def all_within(self, value: str) -> dict[int, int]:
        """Every entry whose occupation is within the core's distance, in the value's band -> least distance."""
        core, band = core_of(value)
        found: dict[str, int] = {}
        for candidate in dict.fromkeys([core, core.replace(" ", "")]):
            for occupation, d in self.trie.search(candidate, allowed(len(candidate))).items() if candidate else ():
                found[occupation] = min(d, found.get(occupation, d))
        return {self._entry(o, band): d for o, d in sorted(found.items(), key=lambda x: (-x[1], x[0]))}

    def _entry(self, occupation: str, band: str | None) -> int:
        if occupation in self.fixed:
            return self.fixed[occupation]
        bands = self.by_band[occupation]
        return bands.get(band or "mid", bands.get("mid", min(bands.values())))

    def match(self, value: str) -> tuple[int, int]:
        """(role_id, distance) of the closest entry; (0, -1) if none fits.  Ties go to the lexically first occupation.

        The automaton's limit rises from none to the distance allowed, so that most values end after one walk.
        """
        core, band = core_of(value)
        candidates = [c for c in dict.fromkeys([core, core.replace(" ", "")]) if c]
        for limit in range(max((allowed(len(c)) for c in candidates), default=-1) + 1):
            hits = [(d, o) for c in candidates if limit <= allowed(len(c)) for o, d in self.trie.search(c, limit).items()]
            if hits:
                d, occupation = min(hits)
                return self._entry(occupation, band), d
        return 0, -1


_NOT_BLANK = "regexp_replace(detected_role, '[\\\\s\\u00a0]', '') <> ''"
#: Most entries of a reference list, which goes to every worker as one trie.
MOST_ENTRIES = 100_000


def _listed(roles: DataFrame) -> list[tuple]:
    rows = roles.select("role_id", "canonical_role", "seniority_band", "is_management", "title_cs").dropna(subset=["role_id", "canonical_role"]).distinct()
    return sorted((tuple(r) for r in small_rows(rows, "the reference list", MOST_ENTRIES)), key=lambda r: (r[0], *map(str, r[1:])))


def match_roles(detected: DataFrame, roles: DataFrame) -> DataFrame:
    """(cv_id, role_id, distance) of every non-blank detected role; role_id 0 is unmatched.

    The reference list is a small fixed table (96 rows) that goes to the workers as one trie.  Null and
    blank values give no row; spellings are matched once each and joined back, so a spelling that many rows
    share costs one match.
    """
    listed = _listed(roles)

    def run(batches):
        m = Matcher(listed)
        for pdf in batches:
            hits = [m.match(v) for v in pdf.spelling]
            yield pd.DataFrame({"spelling": pdf.spelling, "role_id": [h[0] for h in hits], "distance": [h[1] for h in hits]})

    rows = detected.where("cv_id is not null").where(_NOT_BLANK).select("cv_id", F.col("detected_role").alias("spelling")).distinct()
    n = max(int(detected.sparkSession.conf.get("spark.sql.shuffle.partitions")), detected.sparkSession.sparkContext.defaultParallelism)
    # Round robin after the distinct: a keyed repartition would fall together with its exchange and be coalesced into one task.
    spellings = rows.select("spelling").distinct().repartition(n)
    matched = spellings.mapInPandas(run, "spelling string, role_id int, distance int")
    # A spelling may be shared by a third of all rows: its rows are spread over salts, and each match repeated per salt.
    salts = 16
    left = rows.withColumn("salt", F.pmod(F.xxhash64("cv_id"), F.lit(salts)))
    right = matched.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    return left.join(right, ["spelling", "salt"]).select("cv_id", "role_id", "distance")


def all_matches(detected: DataFrame, roles: DataFrame) -> DataFrame:
    """(detected_role, role_id, distance): per distinct spelling every entry within its distance; role_id 0 and distance -1 if none is.

    Null and blank values give no row.
    """
    listed = _listed(roles)

    def run(batches):
        m = Matcher(listed)
        for pdf in batches:
            out = [(v, e, d) for v in pdf.detected_role for e, d in (m.all_within(v) or {0: -1}).items()]
            yield pd.DataFrame(out, columns=["detected_role", "role_id", "distance"])

    n = max(int(detected.sparkSession.conf.get("spark.sql.shuffle.partitions")), detected.sparkSession.sparkContext.defaultParallelism)
    spellings = detected.where(_NOT_BLANK).select("detected_role").distinct().repartition(n)
    return spellings.mapInPandas(run, "detected_role string, role_id int, distance int")


def found_roles(detected: DataFrame, roles: DataFrame) -> DataFrame:
    """p7: (cv_id, role_id)."""
    return match_roles(detected, roles).select("cv_id", F.col("role_id").cast("int")).distinct()
