"""Secret scans: base patterns, and dictionary-primed zstandard novelty for what they miss.

Base spans are matches of three patterns (assignments, access keys, long hex runs).
Beyond them, a candidate is a run of key characters that stands near a sensitive word: shortly
before it, also in the lines above, or behind it in its line; of ``NAME=value`` the value is the
candidate and the name its context, and a run that follows another one after a line break (a key in
several lines) is near what that is near; so is the password of a URL. Its novelty is the number of bytes that zstandard, primed with a
dictionary of common identifiers and of the surrounding code, takes for it, without the constant cost of a frame. It is set against
what random strings of the same form (cases, digits and signs at the same places) take on average in the same surroundings: names, paths
and repetitions take much less, a candidate that takes as much is incompressible and is reported as ``novel``, whatever its length. A
candidate in which letter cases and digits
hardly mix is plain: as zstandard cannot tell a long word from random letters, its letters
must also cost, by the pairs of letters in known words, what random ones cost.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from functools import lru_cache
from math import log2

import zstandard
from pyspark.sql import DataFrame

from kardia.llm.common import documents, map_rows

KINDS = ("assign", "access", "hex", "novel")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24  # characters
LEAST_CANDIDATE = 16  # characters
MIXED = 0.25  # changes between lower case, upper case and digits, per character; a candidate with fewer is plain
NOVEL = 0.88  # marginal bytes, as share of those of random strings of the same form
TWINS = 6  # random strings that a candidate is set against
PLAIN_BITS = log2(26)  # bits per character of a plain candidate by the letters of known words: no less than letters at random
REACH = 64  # characters before and behind a candidate in which a sensitive word stands
AROUND = 256  # characters of surrounding code on either side

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)  # a run is taken whole, so the least length can be in the pattern
URL_USER = re.compile(r"://[^/\s:@]*:$")  # before a password in a URL, which an @ follows
BREAK = re.compile(r"""(?:\s|\\[nrt]|["'+,\\])+""")  # between the lines of one value
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CANDIDATE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# FIXED VALUES: words that make a context sensitive, and common identifiers of code
SENSITIVE = ("access", "apikey", "api_key", "auth", "bearer", "client_id", "connection", "credential", "key", "passphrase", "passwd", "password",
             "private", "pwd", "salt", "secret", "session", "signature", "token", "webhook")
IDENTIFIERS = ("abstract account application array assert async attribute authorization await boolean buffer bytes callback catch char class client "
               "collection column command config configuration connection const constant constructor container content context continue controller count "
               "counter create credential current database date default define delete description directory document double dictionary element else "
               "encoding endpoint enum environment error event exception execute export extends factory false field file filter final finally float "
               "format function generator global handler hash header host http https identifier implements import include index initialize input insert "
               "instance integer interface internal iterator javascript json key lambda length library license list listener local localhost logger "
               "manager master message method model module namespace node none null number object option output override package parameter parse password "
               "path pattern pointer port position prefix private process processor property protected protocol provider proxy public python query queue "
               "random range read record reference register request require resource response result return router schema script search secret select self "
               "sequence server service session setting signature source static status storage stream string struct suffix super switch system table "
               "target template test this thread throw time timestamp token transaction true type undefined unique update upload url user username uuid "
               "value variable vector version void while window worker write www xml yaml")
# and frequent words, which show how letters follow one another
COMMON = ("about above account action after again against all almost alone along already also although always among amount another answer anything "
          "appear area around because become before began behind being believe below between beyond both bring brought build business called came "
          "cannot carry cause center century certain change children city close come common community company complete condition consider continue "
          "control could country course decide develop different difference direction discover during early earth economic education effect effort "
          "either energy enough especially even evening every example experience explain family father feeling field figure finally first follow "
          "force foreign forward friend from general give government great ground group growth happen hard have head health hear heart heavy help "
          "here high history hold home hour house however human hundred idea important include increase indeed industry influence information "
          "inside instead interest international issue itself kind knowledge language large later lead learn leave less letter level light likely "
          "listen little living local long made make making many material matter maybe mean measure meeting member method middle might mind minute "
          "modern money month moral morning mother mountain move much music must name nation national natural near necessary need never nothing "
          "notice number office often once open operation order other outside over paper part particular party past pattern people perhaps period "
          "person physical picture piece place plan plant play point political population position possible power practice present president "
          "pressure probably problem produce product program provide purpose quality question quickly quite rather reach ready reason receive "
          "recent record relation religion remain report research responsible result return right river road room school science second section "
          "seem sense serve several shall short should show side simple since single situation size small social society something sometimes soon "
          "sort sound south special spirit stand start state station still stop story street strength strong structure student study such sudden "
          "suggest support sure surface system table take teacher tell term than that their them theory there therefore these they thing think "
          "those though thought thousand through time today together toward trade training travel tree true trying turn under understand union "
          "university until usually various very view voice walk want watch water week weight well were western what when where whether which "
          "while white whole whose wide will wind window winter within without woman wonder word work world would write written year young")

def _packer(before: str, after: str) -> zstandard.ZstdCompressor:
    """A compressor that knows the identifiers and the surroundings, the nearest last."""
    known = f"{IDENTIFIERS} {COMMON}\n{after}\n{before}".encode("utf-8", "replace")
    primed = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=12, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)


def _cost(packer: zstandard.ZstdCompressor, word: str) -> int:
    return len(packer.compress(word.encode("utf-8", "replace"))) - len(packer.compress(b""))


def marginal_bytes(candidate: str, before: str, after: str) -> int:
    """Bytes that the candidate takes beside its surroundings."""
    return _cost(_packer(before, after), candidate)


_KIND = {c: kind for kind in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") for c in kind}


def twins(word: str) -> list[str]:
    """Random strings of the word's form, the same ones whenever it is met."""
    rng = random.Random(word)
    return ["".join(rng.choice(_KIND[c]) if c in _KIND else c for c in word) for _ in range(TWINS)]


def relative_novelty(word: str, before: str, after: str) -> float:
    """Marginal bytes of a candidate as share of those of its twins, in the same surroundings."""
    packer = _packer(before, after)
    return _cost(packer, word) * TWINS / max(1, sum(_cost(packer, t) for t in twins(word)))


def _novelty(text: str, start: int, end: int) -> int:
    return marginal_bytes(text[start:end], text[max(0, start - AROUND):start], text[end:end + AROUND])


def changes(word: str) -> int:
    """How often neighbouring letters and digits differ in kind; names and paths seldom change."""
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "" for c in word]
    return sum(a != b for a, b in zip(kinds, kinds[1:]) if a and b)


def value_start(text: str, start: int, end: int) -> int:
    """Where the value of ``NAME=value`` begins in a run of key characters; its start if it holds no such name."""
    while (cut := text.find("=", start, end)) >= 0 and text[cut:end].strip("="):
        name = text[start:cut]
        if changes(name) >= MIXED * len(name) and not any(w in name.lower() for w in SENSITIVE):
            break
        start = cut + 1
    return start


def sensitive(text: str, run: int, start: int, end: int) -> bool:
    """Whether a sensitive word stands before the candidate, with its name from ``run`` on, or behind it in its line, or it is a URL's password."""
    before, behind = text[max(0, run - REACH):start].lower(), text[end:end + REACH].partition("\n")[0].lower()
    return any(w in before or w in behind for w in SENSITIVE) or behind.startswith("@") and bool(URL_USER.search(before))


@lru_cache(maxsize=1)
def _followers() -> dict[str, float]:
    """Bits of a letter behind another one, or at the beginning of a word (behind a space), in known words."""
    pairs = Counter(x + y for w in f"{IDENTIFIERS} {COMMON}".split() for x, y in zip(" " + w, w))
    firsts = Counter()
    for pair, n in pairs.items():
        firsts[pair[0]] += n
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {x + y: -log2((pairs[x + y] + 0.5) / (firsts[x] + 13)) for x in " " + letters for y in letters}


def letter_bits(word: str) -> float:
    """Bits of a candidate by the letters of known words; a digit has those of a digit, where letters and digits meet six."""
    bits, last, table = 0.0, " ", _followers()
    for i, c in enumerate(word):
        if c.isdigit():
            bits, last = bits + (log2(10) if last == "0" else 6), "0"
        elif c.isalpha():
            if c.isupper() and i and word[i - 1].islower():
                last = " "
            bits, last = bits + (6 if last == "0" else table[last + c.lower()]), c.lower()
        else:
            bits, last = bits + 3, " "
    return bits


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, ascending; kinds as places in :data:`KINDS`."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        # a match with too short a value is dropped after matching: it still takes its place
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]], threshold: float = NOVEL) -> list[tuple[int, int, int]]:
    """Incompressible candidates near a sensitive word that no base span touches."""
    low = text.lower()
    if "://" not in low and not any(w in low for w in SENSITIVE):
        return []
    found, known, k = [], sorted((a, b) for a, _, b in base), 0
    reached = 0  # largest end of the base spans that start before the candidate ends
    lines: list[tuple[int, int, bool]] = []  # candidates that follow one another, and whether a base span touches them
    near = False  # whether they stand near a sensitive word

    def settle() -> None:
        """Measure the candidates in what surrounds them all: other lines of one key say nothing about the cost of a line."""
        for start, end, touched in lines if near else ():
            if not touched and novel(text[start:end], text[max(0, lines[0][0] - AROUND):lines[0][0]], text[lines[-1][1]:lines[-1][1] + AROUND], threshold):
                found.append((start, 3, end))

    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(known) and known[k][0] < end:
            reached = max(reached, known[k][1])
            k += 1
        start = value_start(text, start, end)
        if end - start < LEAST_CANDIDATE:
            continue
        if not (lines and BREAK.fullmatch(text, lines[-1][1], start)):
            settle()
            lines, near = [], False
        if not near and sensitive(text, m.start(), start, end):
            settle()
            lines, near = [], True
        lines.append((start, end, reached > start))
    settle()
    return found


def novel(word: str, before: str, after: str, threshold: float = NOVEL) -> bool:
    """Whether a candidate is incompressible in its surroundings."""
    if changes(word) < MIXED * len(word) and letter_bits(word) < PLAIN_BITS * len(word):
        return False
    return relative_novelty(word, before, after) >= threshold


def spans(text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + novel_spans(text, base))


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, secrets)`` of each row; null and empty texts have no secrets.

    ``secrets`` lists kind, start and end in code points, and the novelty in bytes, of
    every span. Repeated rows give repeated results.
    """
    def run(cols):
        out = []
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            base = base_spans(text)
            found = sorted(base + novel_spans(text, base))
            counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            out.append({"doc_id": doc_id, "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2],
                        "base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans": _joined(found),
                        "secrets": [{"kind": KINDS[k], "start": a, "end": b, "novelty": _novelty(text, a, b)} for a, k, b in found]})
        return out

    return map_rows(documents(docs, id_col, text_col), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
                    "secrets array<struct<kind:string,start:long,end:long,novelty:long>>")
