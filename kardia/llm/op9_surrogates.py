"""PII: keyed surrogates that keep an entity's type, format, script and gender.

Detected entities are e-mail addresses, IPv4 and IPv6 addresses, card numbers, phone numbers, social
security numbers, IBANs, and names of persons: after a title, a known given name
before a family name, two capitalised words after words such as "my name is", and family names
alone in a document that introduces them. Each is replaced by a surrogate of the same kind:

* digits and letters go through a keyed permutation of all strings of the same length,
  alphabets and format (a Feistel network of keyed BLAKE2 rounds). A permutation maps
  different entities to different surrogates, and the same entity to the same one
  wherever it occurs, so distinctness and coreference hold over the whole corpus
  without any exchange between tasks; the permutation has no fixed points;
* separators, letter case, country codes and the card's issuer digit stay; check
  digits (Luhn, IBAN mod 97) are as right or as wrong as they were;
* a given name becomes another one of its gender and script; a family name keeps its
  script and case, and the mentions "Ms Keller" and "Alice Keller" keep a common family name.

:func:`collisions` checks the result on the corpus: it returns each surrogate that
stands for more than one entity or for itself; :func:`checked` raises if there is one.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from functools import lru_cache
from math import isqrt

from pyspark.sql import DataFrame, SparkSession, functions as F

from kardia.llm.common import documents, map_rows, rewrite_texts

ROUNDS = 8
KEY_SETTING = "spark.kardia.surrogate.key"  # the key; whoever wants equal surrogates in several runs sets it
KINDS = ("email", "iban", "ssn", "ip", "ip6", "card", "phone", "name")

# FIXED VALUES: given names by gender and script, and titles by gender
GIVEN = {
    ("f", "latin"): tuple(("Ada Adele Agnes Aisha Alexandra Alice Alicia Alina Alison Amanda Amelia Amy Ana Anastasia Andrea Angela Angelina Anita Anja "
                     "Ann Anna Anne Annette Annie Antonia Ashley Astrid Audrey Barbara Beate Beatrice Beatriz Bella Bernadette Betty Birgit Brenda "
                     "Bridget Britta Camila Carla Carmen Carol Carolina Caroline Catherine Cecilia Celine Charlene Charlotte Chloe Christina "
                     "Christine Cindy Claire Clara Claudia Colette Cristina Cynthia Dagmar Daniela Danielle Deborah Debra Denise Diana Diane "
                     "Dolores Donna Doris Dorothy Edith Eileen Elaine Eleanor Elena Elisa Elisabeth Elizabeth Ella Ellen Elsa Emily Emma Erika "
                     "Esther Eva Evelyn Fatima Fiona Florence Frances Francesca Franziska Frieda Gabriela Gabriele Georgina Gerda Gisela Giulia "
                     "Gloria Greta Gudrun Hannah Heather Heidi Heike Helen Helena Helga Hilda Ida Ilse Ines Inge Ingrid Irene Irina Iris Isabel "
                     "Isabella Isabelle Jacqueline Jana Jane Janet Janice Jasmine Jean Jeanne Jennifer Jenny Jessica Jill Joan Joanna Johanna "
                     "Josephine Joyce Juana Judith Judy Julia Juliana Julie Juliette Karen Karin Karla Kate Katharina Katherine Kathleen Kathryn "
                     "Katja Kelly Kerstin Kimberly Kirsten Kristina Lara Laura Lauren Lea Lena Leonie Linda Lisa Lorraine Louise Lucia Lucy Luisa "
                     "Lydia Magdalena Manuela Margaret Margarete Margarita Maria Mariana Marie Marina Marion Marlene Marta Martha Martina Mary "
                     "Mathilde Maureen Megan Melanie Melissa Mercedes Mia Michelle Miriam Monica Monika Monique Nadia Nadine Nancy Naomi Natalie "
                     "Natasha Nicole Nina Nora Olga Olivia Pamela Paola Patricia Paula Pauline Petra Pilar Priya Rachel Ramona Rebecca Regina "
                     "Renate Rita Roberta Rosa Rosemary Ruth Sabine Sabrina Sally Samantha Sandra Sara Sarah Sharon Sheila Shirley Silke Silvia "
                     "Simone Sofia Sonia Sonja Sophia Sophie Stephanie Susan Susanne Suzanne Sylvia Tamara Tanja Tara Teresa Theresa Tina Ulrike "
                     "Ursula Ute Valentina Valeria Valerie Vanessa Vera Veronica Victoria Viola Virginia Vivian Wanda Wendy Wilma Yolanda Yvonne "
                     "Zoe").split()),
    ("m", "latin"): tuple(("Aaron Abdul Abraham Achim Adam Adrian Ahmed Alan Albert Alberto Alejandro Alessandro Alex Alexander Alfonso Alfred Ali Allan "
                     "Allen Alvin Andre Andreas Andres Andrew Andy Angelo Anthony Anton Antonio Arnold Arthur Arturo Axel Barry Benedict Benjamin "
                     "Bernard Bernd Bernhard Bill Björn Bob Boris Brandon Brian Bruce Bruno Bryan Carl Carlos Charles Christian Christopher Claude "
                     "Claudio Clemens Colin Craig Curtis Dale Damian Dan Daniel Dario Darren Dave David Dean Dennis Derek Diego Dieter Dietmar Dirk "
                     "Dominic Donald Douglas Duncan Dylan Earl Edgar Edmund Eduardo Edward Edwin Elias Emil Emilio Enrique Eric Erich Erik Ernest "
                     "Ernst Ethan Eugene Evan Fabian Felipe Felix Ferdinand Fernando Florian Francesco Francis Francisco Franco Frank Franz Fred "
                     "Frederick Friedrich Fritz Gabriel Gary Geoffrey Georg George Gerald Gerard Gerhard Gilbert Giorgio Giovanni Giuseppe Glenn "
                     "Gordon Graham Greg Gregor Gregory Guido Guillermo Gustav Günter Günther Hans Harald Harold Harry Hassan Heinrich Heinz Helmut "
                     "Henri Henrik Henry Herbert Hermann Horst Howard Hubert Hugo Ian Ibrahim Ignacio Igor Isaac Ivan Jack Jacob Jacques Jaime Jake "
                     "Jakob James Jamie Jan Jason Javier Jeff Jeffrey Jens Jeremy Jerome Jerry Jesse Jim Jimmy Joachim Joe Joel Johann Johannes "
                     "John Johnny Jon Jonathan Jorge Jose Josef Joseph Joshua José Juan Julian Julio Justin Jürgen Kai Karl Keith Ken Kenneth Kevin "
                     "Klaus Konrad Konstantin Kurt Kyle Larry Lars Lawrence Leo Leon Leonard Leonardo Lewis Liam Lothar Louis Luca Lucas Luis Lukas "
                     "Luke Malcolm Manfred Manuel Marc Marcel Marco Marcus Mario Markus Martin Marvin Mathias Matthew Matthias Maurice Max "
                     "Maximilian Michael Miguel Mike Mohamed Mohammed Moritz Nathan Neil Nicholas Nick Nicolas Niels Nigel Nils Noah Norbert Norman "
                     "Olaf Oliver Omar Oscar Oskar Otto Pablo Paolo Pascal Patrick Paul Pedro Peter Phil Philip Philipp Phillip Pierre Rafael "
                     "Rainer Ralf Ralph Ramon Raphael Raul Ray Raymond Reinhard Reinhold Ricardo Riccardo Richard Rick Rob Robert Roberto Robin "
                     "Rodney Rodrigo Roger Roland Rolf Roman Ron Ronald Ross Rudolf Rupert Russell Ryan Salvador Sam Samuel Santiago Scott Sean "
                     "Sebastian Sergio Siegfried Simon Stanley Stefan Stefano Stephan Stephen Steve Steven Stewart Stuart Sven Ted Terry Theo "
                     "Theodore Thomas Thorsten Tim Timothy Tobias Todd Tom Tommy Tony Tyler Udo Ulrich Uwe Valentin Victor Viktor Vincent Vincenzo "
                     "Vladimir Volker Walter Warren Wayne Werner Wesley Wilhelm William Wolfgang Xavier Yusuf Zachary").split()),
    ("f", "cyrillic"): ("Анастасия", "Екатерина", "Елена", "Людмила", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна", "Юлия"),
    ("m", "cyrillic"): ("Александр", "Алексей", "Владимир", "Дмитрий", "Евгений", "Михаил", "Николай", "Сергей", "Фёдор", "Юрий"),
    ("f", "greek"): ("Αικατερίνη", "Βασιλική", "Ελένη", "Μαρία", "Σοφία"),
    ("m", "greek"): ("Αλέξανδρος", "Γεώργιος", "Δημήτριος", "Κωνσταντίνος", "Νικόλαος"),
}
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
# words after which two capitalised words are a person's name, particles of family names, and capitalised words that are hardly a name by themselves
CONTEXTS = ("my name is", "name is", "name:", "contact:", "contact person:", "author:", "signed,", "signed:", "signed by", "regards,", "sincerely,", "attn:", "attention:", "patient:",
            "patient", "employee:", "customer:", "mein name ist", "ich heiße", "me llamo", "je m'appelle")
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "la", "le", "ter", "zu", "bin", "al")
COMMON = ("Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December "
          "The This That These Those And But Or If In On At To From For With By He She It They We You Is Was Has Had Will Would Said Says").split()
RESERVED = ("example.com", "example.net", "example.org")  # domains that no one owns: they may stay

_GROUP_OF = {n: k for k, names in GIVEN.items() for n in names}
_OTHER_LATIN = "āăąćĉċčďđēĕėęěĝğġģĥħĩīĭįĵķĺļľłńņňōŏőŕŗřśŝşšţťŧũūŭůűųŵŷźżžœ"
_CAPITAL = rf"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆ-Ώ{_OTHER_LATIN.upper()}][a-zß-öø-ÿа-яёα-ωά-ώ{_OTHER_LATIN}]+"
_FAMILY = rf"(?:{'|'.join(PARTICLES)})(?:[ ](?:{'|'.join(PARTICLES)}))*[ ]{_CAPITAL}(?:-{_CAPITAL})?|(?:Mc|Mac|[OD]['’])?{_CAPITAL}(?:-{_CAPITAL})?"
_HEX = "[0-9A-Fa-f]{1,4}"


def _any_of(words) -> str:
    """A pattern of words, dealt by their first two letters, so that few are tried at a place; the longest is taken."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        heads.setdefault(w[:2], []).append(re.escape(w[2:]))
    firsts: dict[str, list[str]] = {}
    for head, tails in heads.items():
        firsts.setdefault(head[0], []).append(f"{head[1:]}(?:{'|'.join(tails)})")
    return "(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in firsts.items()) + ")"


_GIVEN = rf"{_any_of(_GROUP_OF)}(?:-{_any_of(_GROUP_OF)})?(?:[ ]{_any_of(_GROUP_OF)}(?=[ ]{_CAPITAL}))?(?:[ ][A-Z]\.?)?"
_CONTEXT = rf"(?i:\b(?:{'|'.join(map(re.escape, CONTEXTS))}))\s+"
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<ip>(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9]))"
    rf"|(?P<ip6>(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![0-9A-Za-z:]|\.[0-9]))"
    r"|(?P<card>(?<![0-9A-Za-z-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9A-Za-z-]))"
    r"|(?P<phone>(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
    r"|[2-9][0-9]{2}[ ][0-9]{3}[ ][0-9]{4}|(?=(?:[0-9][ /-]?){9,12}(?![0-9]|[ ][0-9]))0[0-9]{1,4}[ /-][0-9]{2,8}(?:[ ][0-9]{2,4}){0,4})(?![0-9]))"
    rf"|(?P<name>\b(?:(?:{'|'.join(TITLES)})\.?[ ](?:{_GIVEN}[ ](?:{_FAMILY})|(?:{_FAMILY})(?:[ ](?!(?:{'|'.join(COMMON)})\b)(?:{_FAMILY}))?)|{_GIVEN}[ ](?:{_FAMILY})))"
    rf"|(?:{_CONTEXT})(?P<named>{_CAPITAL}(?:-{_CAPITAL})?(?:[ ][A-Z]\.?)?[ ](?!(?:{'|'.join(COMMON)})\b)(?:{_FAMILY}))")

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_SCRIPTS = {"latin": _LOWER, "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "greek": "αβγδεζηθικλμνξοπρστυφχψω",
            "other latin": _OTHER_LATIN, "latin accents": "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "greek accents": "άέήίόύώ"}


def _round(key: bytes, tweak: str, r: int, half: int, size: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{r}|{half}|{size}".encode(), key=key).digest(), "big")


def permute(key: bytes, tweak: str, value: int, size: int, back: bool = False) -> int:
    """A keyed permutation of 0 .. size-1, or its inverse: a Feistel network on the least square that holds them, walked until inside."""
    side = isqrt(size - 1) + 1
    while True:
        left, right = divmod(value, side)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = (right - _round(key, tweak, r, left, size)) % side, left
            else:
                left, right = right, (left + _round(key, tweak, r, right, size)) % side
        value = left * side + right
        if value < size:
            return value


def move(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of 0 .. size-1 without fixed points: all values in a shuffled ring, each moved on by one."""
    if size < 2:
        return value
    return permute(key, tweak, (permute(key, tweak, value, size, back=True) + 1) % size, size)


def keep_format(key: bytes, tweak: str, text: str) -> str:
    """Another string of the same format: digits for digits, letters for letters of their script and case, the rest as it is."""
    slots, value, size, form = [], 0, 1, []
    for c in text:
        low = c.lower()
        if c.isascii() and c.isdigit():
            alphabet = "0123456789"
        else:
            alphabet = next((a for a in _SCRIPTS.values() if low in a), "")
        slots.append(alphabet)
        form.append(c if not alphabet else "9" if alphabet[0] == "0" else alphabet[0].upper() if c != low else alphabet[0])
        if alphabet:
            value, size = value * len(alphabet) + alphabet.index(low), size * len(alphabet)
    value = move(key, f"{tweak}|{''.join(form)}", value, size)
    out = []
    for c, alphabet in zip(reversed(text), reversed(slots)):
        if alphabet:
            value, i = divmod(value, len(alphabet))
            out.append(alphabet[i].upper() if c != c.lower() else alphabet[i])
        else:
            out.append(c)
    return "".join(reversed(out))


def _refill(text: str, digits: str) -> str:
    """The text with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isascii() and c.isdigit() else c for c in text)


def _luhn(digits: str) -> int:
    """The check digit that the digits ask for."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _card(key: bytes, text: str) -> str:
    digits = "".join(c for c in text if c.isdigit())
    off = (int(digits[-1]) - _luhn(digits[:-1])) % 10  # 0 for a right check digit; a wrong one stays as wrong
    body = digits[0] + keep_format(key, f"card|{digits[0]}", digits[1:-1])
    return _refill(text, body + str((_luhn(body) + off) % 10))


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _iban(key: bytes, text: str) -> str:
    plain = text.replace(" ", "")
    country, body = plain[:2], plain[4:]
    new = keep_format(key, f"iban|{country}", body)
    off = (int(plain[2:4]) - (98 - _mod97(country + "00" + body))) % 100
    check = f"{(98 - _mod97(country + '00' + new) + off) % 100:02d}"
    it = iter(country + check + new)
    return "".join(c if c == " " else next(it) for c in text)


def _ip(key: bytes, text: str) -> str:
    value = 0
    for part in text.split("."):
        value = value * 256 + int(part)
    value = move(key, "ip", value, 1 << 32)
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


_HEX_ALPHABETS = {"digits": "0123456789abcdef", "lower": "0123456789abcdef", "upper": "0123456789ABCDEF", "both": "0123456789abcdefABCDEF"}


def _hex_kind(text: str) -> str:
    lower, upper = text != text.upper(), text != text.lower()
    return "both" if lower and upper else "lower" if lower else "upper" if upper else "digits"


def _ip6(key: bytes, text: str) -> str:
    """Hex digits change, their number and case and the colons stay; an address spelt in two ways counts as two."""
    kind = _hex_kind(text)
    alphabet, form = _HEX_ALPHABETS[kind], re.sub("[^:]", "f", text)
    digits, new = [c for c in text if c != ":"], text
    value, n = 0, len(alphabet)
    for c in digits:
        value = value * n + alphabet.index(c)
    while new == text or _hex_kind(new) != kind:  # walked until it is of the kind again
        value = move(key, f"ip6|{kind}|{form}", value, n ** len(digits))
        it = iter([alphabet[value // n ** i % n] for i in reversed(range(len(digits)))])
        new = "".join(c if c == ":" else next(it) for c in text)
    return new


def _phone(key: bytes, text: str) -> str:
    """The country code, or the 0 of a national number, stays; all other digits change."""
    m = re.match(r"\+[0-9]{1,3}(?=[ .(-])|0", text)
    head = m[0] if m else ""
    new = text[len(head):]
    while True:
        new = _refill(new, keep_format(key, f"phone|{head}", "".join(c for c in new if c.isdigit())))
        if head or new[0] != "0":
            return head + new


def _email(key: bytes, text: str) -> str:
    """Mailbox and labels change, a reserved domain stays; what was elsewhere moves below ``.invalid``."""
    box, _, domain = text.partition("@")
    base = next((d for d in RESERVED if domain.lower() == d or domain.lower().endswith("." + d)), "")
    if base:
        labels, kept = domain[:-len(base)], domain[-len(base):]
        new = (keep_format(key, "label", labels) if labels else "") + kept
    else:
        new = keep_format(key, "domain", domain) + ".invalid"
    return f"{keep_format(key, 'box', box)}@{new}"


def _unlisted(key: bytes, word: str) -> str:
    """A word of the same form that is no listed given name and no title."""
    while (word := keep_format(key, "family", word)) in _GROUP_OF or word in TITLES:
        pass
    return word


def _name(key: bytes, text: str) -> str:
    words = text.split(" ")
    out = []
    for i, w in enumerate(words):
        if w.rstrip(".") in TITLES or w in PARTICLES:
            out.append(w)
        elif i == len(words) - 1:
            out.append(keep_format(key, "family", w))
        elif w in _GROUP_OF:
            names = GIVEN[_GROUP_OF[w]]
            out.append(names[move(key, f"given|{_GROUP_OF[w]}", names.index(w), len(names))])
        else:
            out.append(_unlisted(key, w))
    return " ".join(out)


_MAKERS = {"email": _email, "iban": _iban, "ssn": lambda k, t: keep_format(k, "ssn", t), "ip": _ip, "ip6": _ip6, "card": _card, "phone": _phone, "name": _name}
_DIGITS = re.compile(r"[0-9]{2}|[0-9]\.[0-9]|::|[0-9A-Fa-f]:[0-9A-Fa-f]")
_ALONE = re.compile(rf"(?<![\w-])(?:Mc|Mac|[OD]['’])?{_CAPITAL}(?:-{_CAPITAL})?(?![\w-])")
_INTRODUCED = re.compile(_CONTEXT)
_CAPITALS = re.compile(_CAPITAL)
_NAME_WORDS = frozenset([*TITLES, *_GROUP_OF])


class Surrogates:
    """Detects entities and makes their surrogates under one key."""

    def __init__(self, key: bytes, remembered: int = 100_000):
        self.key = key
        self.make = lru_cache(maxsize=remembered)(lambda kind, text: _MAKERS[kind](key, text))

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of the entities of a text, in code points, from left to right."""
        if "@" not in text and not _DIGITS.search(text) and _NAME_WORDS.isdisjoint(_CAPITALS.findall(text)) and not _INTRODUCED.search(text):
            return []
        found = [("name" if m.lastgroup == "named" else m.lastgroup, *m.span(m.lastgroup)) for m in PATTERN.finditer(text)]
        families = {text[a:b].rpartition(" ")[2] for kind, a, b in found if kind == "name"}.difference(COMMON)
        if families:  # they also stand alone
            taken = iter([*found, ("", len(text), len(text))])
            alone, (_, a, b) = [], next(taken)
            for m in _ALONE.finditer(text):
                if m[0] not in families:
                    continue
                while b <= m.start() and b < len(text):
                    _, a, b = next(taken)
                if m.end() <= a or m.start() >= b:
                    alone.append(("name", *m.span()))
            found = sorted(found + alone, key=lambda f: f[1])
        return found

    def replace(self, text: str) -> tuple[str, list[tuple[str, str, str]]]:
        """The text with surrogates, and (kind, entity, surrogate) of each occurrence."""
        out, at, made = [], 0, []
        for kind, start, end in self.find(text):
            entity = text[start:end]
            surrogate = self.make(kind, entity)
            out += [text[at:start], surrogate]
            at = end
            made.append((kind, entity, surrogate))
        return "".join(out) + text[at:], made


_session_keys: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The key that the job's setting names; without one, a random key of this application, which is kept nowhere: its
    surrogates can't be made again, nor compared with those of another run."""
    named = spark.conf.get(KEY_SETTING, None)
    if named:
        return named.encode()[:64]
    return _session_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


_made: dict[bytes, Surrogates] = {}


def surrogates(key: bytes) -> Surrogates:
    """The surrogate maker of a key, kept by the worker process."""
    if key not in _made:
        _made[key] = Surrogates(key)
    return _made[key]


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_entities, kinds, text, entities)`` of each row: counts by kind, the new text, and what was replaced.

    Null texts count as empty and have no entities. Repeated rows give repeated results.
    ``entities`` holds the originals: it is for checks, not for release.
    """
    def run(cols):
        out = []
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            new, made = surrogates(key).replace(text)
            out.append({"doc_id": doc_id, "n_entities": len(made), "kinds": ",".join(f"{k}:{n}" for k in KINDS if (n := sum(m[0] == k for m in made))),
                        "text": new, "entities": [{"kind": k, "entity": e, "surrogate": s} for k, e, s in made]})
        return out

    return map_rows(documents(docs, id_col, text_col), run, "doc_id long, n_entities long, kinds string, text string, entities array<struct<kind:string,entity:string,surrogate:string>>")


def collisions(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(kind, surrogate, n_entities)`` of the surrogates that stand for more than one entity, or for themselves.

    Only distinct pairs of entity and surrogate are shuffled; texts aren't.
    """
    def run(cols):
        return [{"kind": k, "entity": e, "surrogate": s} for k, e, s in {m for t in cols["text"] for m in surrogates(key).replace(t)[1]}]

    pairs = map_rows(documents(docs, id_col, text_col).select("text"), run, "kind string, entity string, surrogate string").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n_entities"), F.max(F.col("entity") == F.col("surrogate")).alias("same")).where("n_entities > 1 OR same").drop("same")


def checked(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` itself, after the check that their surrogates are distinct under this key."""
    found = collisions(docs, key, id_col, text_col).limit(5).collect()
    if found:
        raise ValueError(f"surrogates that stand for several entities: {[(r.kind, r.n_entities) for r in found]}")
    return docs


def replace_texts(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in its texts and, where there is a column ``n_chars``, the new lengths; all else stays."""
    new = rewrite_texts(docs, text_col, lambda texts: [surrogates(key).replace(t)[0] for t in texts])
    return new.withColumn("n_chars", F.coalesce(F.length(text_col), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new
