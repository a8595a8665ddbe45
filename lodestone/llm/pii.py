"""Personal information in free text: found, and replaced by keyed, linkable placeholders."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import text_batches

#: The key of the pseudonyms. A caller who needs secrecy passes an own one.
DEFAULT_KEY = "lodestone-demo-key"
MAX_GIVEN_NAMES = 1_000_000

_S = "[ \u00a0\u2009\u202f\t]"
_UP = "".join(chr(c) for c in range(0x41, 0x250) if unicodedata.category(chr(c)) == "Lu")
_LETTER = f"[^\\W\\d_]"

# --- mail addresses -------------------------------------------------------------------------------------
_AT = rf"(?:@|%40|&#64;|{_S}?[(\[{{](?:at|AT|a|ät)[)\]}}]{_S}?)"
_DOT = rf"(?:\.|{_S}?[(\[{{](?:dot|DOT|punkt|punto|point)[)\]}}]{_S}?)"
EMAIL_AT = re.compile(_AT)
_EMAIL_HOST = re.compile(rf"[^\W_][\w\-]*(?:{_DOT}[\w\-]+)*{_DOT}[^\W\d_]{{2,}}(?![\w\-]|{_DOT}\w|:[\w~/])")

# --- identity numbers: a label decides; the number is what follows it ------------------------------------
#: Labels of identity numbers.
_ID_LABELS = (
    "social security (?:no|number)", "social insurance (?:no|number)", "SSN", "TIN", "tax (?:id|no|number)", "passport", "ID card", "identity card", "national ID",
    "DNI", "NIF", "NIE", "número de la seguridad social", "pasaporte", "documento de identidad",
    "NIR", "n[°ºo] de sécurité sociale", "numéro de sécurité sociale", "numéro fiscal", "carte d['’]identité", "passeport", "CNI",
    "Steuer-ID", "Steuerliche Identifikationsnummer", "Steueridentifikationsnummer", "Steuernummer", "Sozialversicherungsnummer", "Personalausweis(?:nummer|-Nr)?", "Ausweis(?:nummer|-Nr)", "Reisepass(?:nummer|-Nr)?",
)
_ID_SHAPES = (
    r"\d{2}\.?\d{3}\.?\d{3}-?[A-Z]", r"[XYZ]-?\d{7}-?[A-Z]", rf"[12]{_S}?\d\d{_S}?\d\d{_S}?(?:\d\d|2[AB]){_S}?\d{{3}}{_S}?\d{{3}}{_S}?\d\d",
    rf"\d{{3}}[\- ]\d{{2}}[\- ]\d{{4}}", rf"\d{{2}}{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}", r"[A-Z]{1,2}\d{6,9}[A-Z]?", r"[A-Z0-9]*\d[A-Z0-9]{7,12}", r"\d{2,3}/\d{3,4}/\d{4,5}", r"\d{8,15}",
)
ID_NUMBER = re.compile(
    rf"(?<!\w)(?:(?i:{'|'.join(_ID_LABELS)}))\.?(?:{_S}(?:on file|no|number|card|Nr|nº|n[°º]))?\.?[\"']?{_S}?[:=#]?{_S}?[\"']?({'|'.join(f'(?:{s})' for s in _ID_SHAPES)})(?![\w]|[\-./]\w)"
)

# --- telephone numbers ------------------------------------------------------------------------------------
PHONE = re.compile(
    r"(?<![\w#])(?<!\w[.\-/])(?<!\d:)(?:"
    rf"\+\d{{1,3}}(?:[ .\-/\u00a0]?\(0?\d{{0,4}}\))?(?:[ .\-/\u00a0]?\d{{1,8}}){{1,6}}"
    rf"|00\d{{2}}(?:[ .\-/\u00a0]\d{{1,8}}){{1,6}}"
    rf"|\(\d{{3}}\)[ \u00a0]?\d{{3}}[\-.  ]\d{{4}}|\(0\d{{1,4}}\)[ \u00a0]?\d{{2,8}}(?:[ \-\u00a0]\d{{2,8}}){{0,3}}"
    r"|(?:1[\-. ])?\d{3}([\-. ])\d{3}\1\d{4}|0\d{1,4}/\d{3,8}(?:[\- ]\d{1,5})?|0[1-9](?:[ \u00a0]\d{2}){4}|0[1-9](?:\.\d{2}){4}|0\d{2,4}[ \-]\d{3,5}[ \-]\d{3,5}|[6789]\d{2}(?: \d{3}){2}"
    r"|1[2-9]\d{2}[2-9]\d{6}"
    r")(?!\w|[\-./:]\d)"
)

#: Dates of birth: a label, then a date by numbers.
BIRTH_DATE = re.compile(
    r"(?<!\w)(?i:born(?: on)?|date of birth|dob|birth ?da(?:y|te)|geboren(?: am)?|geburtsdatum|geb\.|nacid[oa](?: el)?|fecha de nacimiento|née? le|date de naissance)[\"']?[ :=]{0,3}[\"']?(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}([./\-])\d{1,2}\2\d{4})(?![\w]|[\-./]\d)"
)

_NUMBER_RUN = re.compile(r"[+(\d][\d .()/\-\u00a0]{6,}\d")
_WHOLE = re.compile(r"(?s).+")

# --- street addresses -------------------------------------------------------------------------------------
_CAP = f"[{_UP}]\\w*(?:['’]\\w+)*"
_EN_TYPE = "Street|St\\.|St|Road|Rd\\.?|Lane|Ln\\.?|Avenue|Ave\\.?|Boulevard|Blvd\\.?|Drive|Dr\\.?|Court|Ct\\.?|Terrace|Ter\\.|Place|Pl\\.|Way|Square|Sq\\.|Crescent|Close|Row|Parkway|Pkwy\\.?|Highway|Hwy\\.?"
_EN_MORE = rf"(?:,?{_S}(?:(?:Apt|Apartment|Suite|Ste|Unit|Flat|Floor|Fl|Room|Rm)\.?{_S}?#?\w{{1,5}}\b|#{_S}?\d+\w?))?"
_FR_WORDS = "rue|avenue|boulevard|chemin|place|allée|impasse|quai|route|cours|passage|square|sentier|ruelle|Rue|Avenue|Boulevard|Chemin|Place|Allée|Impasse|Quai|Route|Cours|Passage"
_ES_WORDS = "Calle|C/|Avenida|Avda\\.?|Av\\.|Plaza|Pza\\.?|Paseo|Camino|Ronda|Travesía|Carretera|Glorieta"
_NO_CAP = f"(?:{_CAP}(?:[\\-]{_CAP})*)"
_EN_NEAR = re.compile(rf"\d[A-Za-z]?{_S}[{_UP}]")
_FR_NEAR = re.compile(rf"\d(?:{_S}?(?:bis|ter|quater|[A-D]))?,?{_S}(?:{_FR_WORDS})")
_ES_NEAR = ("Calle", "C/", "Avenida", "Avda", "Av.", "Plaza", "Pza", "Paseo", "Camino", "Ronda", "Travesía", "Carretera", "Glorieta")
_DE_ENDS = ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer", "steig", "pfad", "chaussee", "stieg", "hof", "markt", "graben", "wall")
_DE_NEAR = re.compile(rf"[a-zß.]{_S}\d")


_HOUSE_NUMBER = re.compile(r"\d")


def _near_german(text: str) -> bool:
    return any(text[max(0, m.start() - 11) : m.start() + 1].lower().endswith(_DE_ENDS) for m in _DE_NEAR.finditer(text))


#: Cheap tests without which the pattern of the same position cannot match.
_ADDRESS_TESTS = (_EN_NEAR.search, _FR_NEAR.search, lambda text: any(w in text for w in _ES_NEAR), _near_german)
ADDRESSES = tuple(
    (test, re.compile(pattern))
    for test, pattern in zip(
        _ADDRESS_TESTS,
        (
            rf"\d(?<![\w.#/\-]\d)\d{{0,4}}[A-Za-z]?{_S}(?:(?:[NSEW]|NE|NW|SE|SW)\.?{_S}|(?:North|South|East|West){_S})?(?:{_NO_CAP}{_S}){{1,3}}(?:{_EN_TYPE})(?!\w){_EN_MORE}",
            rf"\d(?<![\w.#/\-]\d)\d{{0,3}}(?:{_S}?(?:bis|ter|quater|[A-D]))?,?{_S}(?:{_FR_WORDS})(?:{_S}(?:de|du|des|la|le|les|aux|au)\b|{_S}?(?:de{_S})?[dlDL]['’])*{_S}?{_NO_CAP}(?:{_S}{_NO_CAP}){{0,2}}",
            rf"(?<!\w)(?:{_ES_WORDS})(?:{_S}?(?:de|del|la|las|los|el)\b)*{_S}?{_NO_CAP}(?:{_S}(?:(?:de|del|la|las|los){_S})*{_NO_CAP}){{0,3}},?{_S}?(?:(?:nº|n\.º|n°|núm\.|num\.){_S}?)?\d{{1,4}}(?:{_S}?(?:bis|[A-D])\b)?(?:,{_S}?\d{{1,2}}[.ºª°]+{_S}?(?:[A-Z]\b|izq\.?|dcha\.?|izda\.?)?)?(?:,{_S}?(?:bajo|piso{_S}\d+|esc\.{_S}?\w|puerta{_S}\w+)\b)?",
rf"(?<![\w\-])(?:[{_UP}]{_LETTER}*(?:-[{_UP}]{_LETTER}*)*-?(?:[sS]traße|[sS]trasse|[sS]tr\.|[wW]eg|[gG]asse|[aA]llee|[pP]latz|[rR]ing|damm|ufer|steig|pfad|chaussee|stieg|hof|markt|graben|wall)|{_NO_CAP}{_S}(?:Straße|Strasse|Str\.|Weg|Gasse|Allee|Platz|Ring|Damm|Ufer|Steig|Pfad|Chaussee)){_S}\d{{1,4}}(?:{_S}?[a-z]\b|{_S}?[\-–/]{_S}?\d{{1,4}}[a-z]?\b)?(?!\w)",
        ),
    )
)

# --- names -------------------------------------------------------------------------------------------------
_PARTICLE = "(?:[vV]on|[vV]an|[dD]e|[dD]el|[dD]ella|[dD]er|[dD]en|[dD]em|[dD]i|[dD]a|[dD]os|[dD]u|[dD]es|[lL]a|[lL]as|[lL]os|[lL]e|[zZ]u|[zZ]ur|[tT]en|[tT]er|[aA]l|[bB]in|[aA]f|VON|VAN|DE|DEL|DER|DEN|LA|LE|DU|ZU|DI|DA)"
_GIVEN = f"[{_UP}]{_LETTER}+(?:-[{_UP}]{_LETTER}+)?"
_FAMILY = f"(?:[OoDdLl]['’])?[{_UP}]{_LETTER}+(?:['’\\-][{_UP}]?{_LETTER}+)*"
_INITIALS = f"(?:{_S}[{_UP}]\\.(?:{_S}?-?[{_UP}]\\.)*)"
_PLAIN = f"{_GIVEN}{_INITIALS}?(?:{_S}{_PARTICLE})*{_S}{_FAMILY}"
_TURNED = f"(?:{_PARTICLE}{_S})*{_FAMILY},{_S}{_GIVEN}{_INITIALS}?(?!{_LETTER})"
_INITIAL_FIRST = f"[{_UP}]\\.(?:{_S}?[{_UP}]\\.)*(?:{_S}{_PARTICLE})*{_S}{_FAMILY}"
_ONE = f"(?:{_TURNED}|{_PLAIN}|{_INITIAL_FIRST})"
_ONE_PLAIN = f"(?:{_PLAIN}|{_INITIAL_FIRST})"
_END = f"(?!{_LETTER}|['’\\-]{_LETTER})"

#: Evidence for a person around a capitalised pair of words, in points; NAME_POINTS make a name.
NAME_POINTS = 2.0
#: Words before a name: who acts on or towards a person, how people are addressed, what merely relates.
_BEFORE = (
    dict.fromkeys("by von por par @author cc thanks thank kudos credit credits danke dank gracias merci ask asked asking call called calling contact contacting ping pinged tell told met meet meets meeting heard hired invited interviewed notify notified email emailed mail mailed message messaged assigned reviewer reporter speaker colleague engineer manager director professor hi hello hey dear hallo hola bonjour liebe lieber bitte frag fragt frage ruf ruft rufen anrufen kollege kollegin llamad llamen llamar llame llama preguntad pregunte preguntar avisad avise contactad contacte appelez appeler demandez demander contactez contacter prévenez prévenir speak speaking talk talking sprich sprach spreche sprechen habla hablad hable hablar hablé parle parlez parler parlé".split(), 2.0)
    | dict.fromkeys("mr mrs ms miss dr prof sir herr frau fräulein señor señora sr sra srta don doña monsieur madame mme mlle maître".split(), 3.0)
    | dict.fromkeys("to with from for of and about at than via an mit bei für und zu zum mit a con para de y desde à avec pour et chez behind between after before when while whether if that because as unless until dass weil wenn ob als que si porque cuando lorsque quand".split(), 1.0)
)
_INTRODUCED = ("name is", "i am", "i'm", "this is", "name ist", "ich bin", "ich heiße", "me llamo", "nombre es", "soy", "m'appelle", "je suis", "nom est", "c'est")
#: Words after a name: what people do.
_AFTER = frozenset(
    "wrote writes said says asked asks replied replies reported reports noticed notes noted found finds fixed fixes joined joins thinks thought speak speaks spoke told tells suggested suggests proposed proposes agreed agrees confirmed confirms reviewed reviews approved approves merged who whose signed visited presented explained owns leads led works worked lives called calls sent sends opened answered "
    "schrieb schreibt sagte sagt meldete meldet fragte fragt fand findet meinte meint hat wohnt arbeitet gesprochen telefoniert getroffen vereinbart "
    "escribió escribe dijo comentó cree avisó dice preguntó informó encontró propuso vive trabaja quien "
    "écrit dit demande propose habite travaille signale qui".split()
)
#: Labels of fields, tags and comments that hold a person.
_LABELS = frozenset(
    "author authors owner owners maintainer maintainers contact contacts assignee assignees reviewer reviewers reporter user username customer name names fullname full_name person signed-off-by reviewed-by co-authored-by reported-by acked-by tested-by approved-by "
    "autor autorin name kontakt ansprechpartner bearbeiter nombre contacto responsable auteur nom".split()
)
_OPENING = "\"'«„“‘    \t"
_JOINED = re.compile(r"[\"']?\s*(?:[,;/&+]|and|und|y|e|et|or|oder|o|ou)\s*(?:and\s|und\s|y\s|et\s)?[\"']?(?:@?\w*\s)?")
_PHONE_NEXT = re.compile(rf",?{_S}?(?:(?:at|on|unter|al|au|ext|tel|phone|Tel|Telefon)\.?:?{_S}?)?[+(]?\d[\d ().\-/]{{6}}")
_MAIL_NEXT = re.compile(rf"{_S}?[<(|]?{_S}?(?:mailto:)?[\w.+\-]+(?:@|{_S}?[(\[]at|%40|&#64;)")
_NEXT_WORD = re.compile(rf",?{_S}(?:a{_S})?([^\W\d_]+)")
_TURNED_AT, _PLAIN_AT, _INITIAL_AT = (re.compile(f"({p}){_END}") for p in (f"{_FAMILY},{_S}{_GIVEN}{_INITIALS}?(?!{_LETTER})(?!{_S}{_FAMILY})", _PLAIN, _INITIAL_FIRST))
_TURNED_LOOSE = re.compile(f"({_FAMILY},{_S}{_GIVEN}{_INITIALS}?(?!{_LETTER})){_END}")
_SIGNED_END = re.compile(rf"\s*(?:$|\n)|{_S}[{_UP}]")
_PARTICLES_BEFORE = re.compile(f"(?:(?<!\\w){_PARTICLE}{_S})+$")
_START = re.compile(f"(?<![\\w.@\\-])(?<!\\w['’])[{_UP}](?=(?:\\.|{_LETTER}|['’][{_UP}])[^\\W_]*(?:['’.\\-]\\w*)*,?{_S}(?:{_PARTICLE}{_S})*[{_UP}])")
_SIGNED = re.compile(rf"(?:^|[.!?:;]{_S}|\n)[^\S\n]*(?:[/#*>|\-]+{_S})?--{_S}$")
#: Products and releases: what is said of them, and articles before them.
_PRODUCT_AFTER = re.compile(rf"{_S}?(?:(?:is|was|ist|es|est){_S}(?:the|a|an|der|die|das|ein|eine|el|la|un|una|le|une){_S}|needs{_S}|requires{_S}|v?\d+\.\d|[Rr]elease|[Vv]ersion|(?:rule|loader|print|module|service|dashboard|panel|plugin|library|package|theme|build|edition|server|client|cluster)\b)")
_ARTICLES = frozenset("the a an der die das den dem ein eine einen einem el la los las un una le les une only each every this that these our your their its jede jeder unser".split())
#: Words that open a sentence or a notice or name times and are no part of a name.
_NOT_NAMES = frozenset(
    "The This That Then Please Note Since When After Before Title Fixes Could Both Every Half Nobody Our Set Users What Does Without Calling Rename Profiling Reading Bumping Again Sadly "
    "Reported Reviewed Signed Thanks Author Owner Contact Questions Gemeldet Bitte Danke Kurz Hinweis Der Die Das Ein Eine Im Informado Gracias Llamad Dudas Nota Ojo El La Los Las En Signalé Merci Appelez Le Les Un Une Nous "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December Dr Mr Mrs Ms Prof Herr Frau Monsieur Madame My Dear Hello Call Ask If And But For With From".split()
)
_UNSURE = re.compile(f"[{_UP}]{{2,}}$|.*[a-zß][{_UP}]")


#: Pieces of labels in lower case: short ones, which are parts of many words, and long ones.
_ID_SHORT = ("ssn", "tin", "dni", "nif", "nie", "nir", "cni")
_ID_SHORT_NEAR = re.compile(rf"(?<!\w)(?i:{'|'.join(_ID_SHORT)})(?:{_S}|[\dA-Z.\"':=#])")
_ID_GATES = ("social s", "social i", "tax i", "tax n", "passport", "id card", "identity card", "national id", "seguridad s", "pasaporte", "de identidad", "sécurité s", "fiscal", "identité", "passeport", "steuer", "sozialv", "ausweis", "reisepass")


#: Letters that match others in any case but are not lower-cased to them.
_ODD_CASE = re.compile("[ſıİ]")
_SPACES = (" ", "\u00a0", "\u2009", "\u202f", "\t")
_EMAIL_GATES = ("@", "at)", "at]", "at}", "%40", "&#64", "ät") + tuple(f"{a}a{b}" for a in "([{" for b in ")]}")


class Finder:
    """Finds mail addresses, phone and identity numbers, dates of birth, street addresses and names of persons.

    Each pattern runs only over texts that hold a piece of text it needs; without
    ``tests`` over all texts, which finds the same.
    """

    def __init__(self, given_names: Iterable[str] = (), tests: bool = True):
        self._all = not tests
        names = {n.strip() for n in given_names if n and n.strip()}
        self._given = names | {n.upper() for n in names}
        # names of several words, by their first
        self._longer: dict[str, list[str]] = {}
        for n in sorted(self._given):
            if re.search(_S, n):
                self._longer.setdefault(re.split(_S, n)[0], []).append(n)

    @staticmethod
    def _near_id(text: str, low: str) -> bool:
        if any(g in low for g in _ID_GATES) or (any(g in low for g in _ID_SHORT) and _ID_SHORT_NEAR.search(text)):
            return True
        return not text.isascii() and bool(_ODD_CASE.search(text))

    @staticmethod
    def _word_before(text: str, at: int) -> tuple[str, int]:
        """The word (with ``@``, ``-``, dots of titles left out) that ends at ``at`` behind quotes and spaces, in lower case, and its start."""
        end = at
        while end and text[end - 1] in ". ":
            end -= 1
        start = end
        while start and (text[start - 1].isalnum() or text[start - 1] in "_@-'’"):
            start -= 1
        return text[start:end].lower().lstrip("'’-"), start

    def _evidence_before(self, text: str, start: int) -> float:
        at = start
        while at and text[at - 1] in _OPENING:
            at -= 1
        if at and text[at - 1] == "\n":
            back = at
            while back and text[back - 1] in " \t\r\n":
                back -= 1
            at = back if text[back - 1 : back] == "[" else at  # a list over several lines
        if not at or text[at - 1] in "\n.!?":
            return 0.5  # opens a sentence
        c = text[at - 1]
        if c in ":=[(":
            while at and text[at - 1] in ":=[( \"'\n\t":
                at -= 1
            word, _ = self._word_before(text, at)
            return 3.0 if word.lstrip("@") in _LABELS else 2.0 if word in ("cc", "by", "thanks") else 0.0
        if c == ">":
            tag = text.rfind("<", max(0, text.rfind("\n", 0, at)), at)
            return 3.0 if tag >= 0 and re.split(r"[\s>]", text[tag + 1 : at].lower())[0] in _LABELS else 0.0
        if c == "-" and text[at - 2 : at] == "--":
            line = max(text.rfind("\n", 0, at), text.rfind(". ", 0, at) - 1, text.rfind("! ", 0, at) - 1, text.rfind("? ", 0, at) - 1, text.rfind("; ", 0, at) - 1, text.rfind(": ", 0, at) - 1, -1)
            return 3.0 if _SIGNED.search(text, max(0, line), start) else 0.0
        word, begin = self._word_before(text, at)
        if not word:
            return 0.0
        points = _BEFORE.get(word, 0.0)
        if 0 < points < 2.0 and text[begin - 1 : begin] == " ":
            # "thanks to", "spoke with", "danke an", "llamad a": the word before counts as well
            before, _ = self._word_before(text, begin)
            if _BEFORE.get(before, 0.0) >= 2.0 or before in _AFTER or before.endswith("ed") or before in ("paired", "spoke", "talked", "thank", "written"):
                return 2.0
        if word in _ARTICLES:
            return -3.0
        if word.lstrip("@") in _LABELS and word[0] == "@":
            return 3.0
        if points < 2.0 and word in ("is", "am", "i'm", "ist", "bin", "heiße", "llamo", "es", "soy", "suis", "est", "m'appelle", "c'est"):
            before, _ = self._word_before(text, begin)
            if word in ("i'm", "soy", "heiße", "llamo", "m'appelle") or f"{before} {word}" in _INTRODUCED:
                return 3.0
        if not points and word.isalpha() and text[at - 1] != ".":
            return 0.5  # inside a sentence
        return points

    def _evidence_after(self, text: str, end: int) -> float:
        if _MAIL_NEXT.match(text, end):
            return 3.0
        if _PHONE_NEXT.match(text, end):
            return 1.0
        m = _NEXT_WORD.match(text, end)
        if not m:
            return 0.5 if text[end : end + 1] in (".", ",", "", "\n") else 0.0
        word = m[1]
        if word in _AFTER:
            return 2.0 if text[m.end() : m.end() + 2].lstrip(" ").startswith(":") else 1.5
        return 0.0

    def names(self, text: str, others: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
        """Capitalised pairs in the shape of a name for which the points of their surroundings, parts and neighbours suffice.

        ``others`` are the places of other findings and whether they are street addresses: people stand
        beside their numbers and addresses, towns right behind the latter, labels right before the former.
        """
        done = joined = -1
        places = sorted({x[:2] for x in others})
        firsts = [a for a, _ in places]
        streets = {b for _, b, street in others if street}
        for m in _START.finditer(text):
            start = m.start()
            if start < done:
                continue
            n = _TURNED_AT.match(text, start)
            if not n and (n := _TURNED_LOOSE.match(text, start)) and self._evidence_before(text, start) < 2.0:
                n = None  # rather one word, a comma and a name
            n = n or _PLAIN_AT.match(text, start) or _INITIAL_AT.match(text, start)
            if not n:
                continue
            end, inner = n.end(1), n[1]
            words = re.split(r"[\s,]+", inner)
            turned = "," in inner
            given = words[1 if turned and len(words) > 1 else 0] if not turned else re.split(f",{_S}", inner)[1].split()[0]
            listed = given in self._given or any(text.startswith(f, start) and text[start + len(f) : start + len(f) + 1].isspace() for f in self._longer.get(words[0], ()))
            if words[0] in _NOT_NAMES or words[-1] in _NOT_NAMES or _PRODUCT_AFTER.match(text, end):
                continue
            at = bisect_left(firsts, start)
            if (at and places[at - 1][1] > start) or (at < len(places) and (places[at][0] < end or not text[end : places[at][0]].strip(" :=#.\u00a0") and text[end : places[at][0]] != "")):
                continue  # a part of another finding, or its label
            if start - 2 in streets and text[start - 2 : start] == ", ":
                continue  # the town
            points = self._evidence_before(text, start)
            if turned and text[start - 2 : start - 1].isalpha() and (more := _PARTICLES_BEFORE.search(text, text.rfind("\n", 0, start) + 1, start)):
                further = self._evidence_before(text, more.start())
                if further >= max(points, 1.0):  # else it relates the name to what stands before
                    start, points = more.start(), further
            if points < 0:
                continue
            if text[start - 3 : start - 1] == "--" and not _SIGNED_END.match(text, end):
                points = 0.0  # a remark, not a signature
            shouted = inner.isupper() and min(map(len, words)) > 3
            if listed:
                points += 3.0
            elif shouted:
                word, begin = self._word_before(text, start)
                points -= 2.0 if len(word) > 1 and text[begin : begin + len(word)].isupper() else 0.0  # all is in capitals here
            elif _UNSURE.match(words[0]) or _UNSURE.match(words[-1]) and "'" not in inner and "’" not in inner:
                points -= 1.0  # acronyms and inner capitals are rather products
            if joined >= 0 and _JOINED.fullmatch(text, joined, start):
                points += 2.0  # named along with another person
            if points < NAME_POINTS:
                after = self._evidence_after(text, end)
                points += after if not turned or after >= 2.0 or points >= 1.0 else 0.0
            if len(words) > 2:
                points += 0.5  # initials, particles
            if turned and points < 1.0:
                continue  # two items of a list look the same
            if points < NAME_POINTS and places and self._beside(text, start, end, places, firsts):
                points += 2.0 if text[end : end + 1] in (";", "|", "\t") else 1.0  # in a sentence, in a record
            if points >= NAME_POINTS:
                done, joined = end, end
                yield start, end

    @staticmethod
    def _beside(text: str, start: int, end: int, others: list[tuple[int, int]], firsts: list[int]) -> bool:
        """Whether another finding stands in the same sentence or record."""
        i = bisect_left(firsts, start)
        gaps = [text[others[i - 1][1] : start]] if i else []
        gaps += [text[end : others[i][0]]] if i < len(others) else []
        return any("\n" not in g and not re.search(r"[.!?]\s", g) for g in gaps)

    def emails(self, text: str) -> Iterator[tuple[int, int]]:
        for m in EMAIL_AT.finditer(text):
            start = end = m.start()
            while start and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
                start -= 1
            while start < end and not text[start].isalnum():
                start += 1
            if start < end and text[start:end].lower() != "git" and (host := _EMAIL_HOST.match(text, m.end())):
                yield start, host.end()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Disjoint ``(start, end, kind)`` in order of position."""
        low = text.lower()
        spans: list[tuple[int, int, int, str]] = []
        if self._all or any(g in low for g in _EMAIL_GATES):
            spans += [(a, b, 0, "email") for a, b in self.emails(text)]
        if self._all or _HOUSE_NUMBER.search(text):
            if self._all or self._near_id(text, low):
                spans += [(*m.span(1), 1, "id_number") for m in ID_NUMBER.finditer(text)]
            spans += [(*m.span(1), 1, "date") for m in BIRTH_DATE.finditer(text) if read_date(m[1])]
            for test, pattern in ADDRESSES:
                if self._all or test(text):
                    spans += [(*m.span(), 2, "address") for m in pattern.finditer(text)]
            for run in (_WHOLE if self._all else _NUMBER_RUN).finditer(text):
                for m in PHONE.finditer(text, run.start(), min(len(text), run.end() + 3)):
                    if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                        spans.append((*m.span(), 3, "phone"))
        spans += [(a, b, 4, "name") for a, b in self.names(text, [(a, b, kind == "address") for a, b, _, kind in spans])]
        out: list[tuple[int, int, str]] = []
        taken = bytearray(len(text)) if spans else bytearray()
        for a, b, _, kind in sorted(spans, key=lambda s: (s[2], s[0], s[0] - s[1])):
            if not any(taken[a:b]):
                taken[a:b] = b"\x01" * (b - a)
                out.append((a, b, kind))
        return sorted(out)


# --- pseudonyms -----------------------------------------------------------------------------------------------
def _round(key: bytes, n: int, value: int, radix: int, tweak: bytes) -> int:
    digest = hashlib.blake2b(b"%d|%d|%d|" % (n, radix, value) + tweak, key=key[:64], digest_size=12).digest()
    return int.from_bytes(digest, "big") % radix


def feistel(value: int, low: int, high: int, key: bytes, tweak: bytes = b"", rounds: int = 10, back: bool = False) -> int:
    """A keyed permutation of ``0 .. low*high - 1`` as an alternating Feistel network over two digits of radix ``low`` and ``high``."""
    a, b = divmod(value, high)
    for n in reversed(range(rounds)) if back else range(rounds):
        sign = -1 if back else 1
        if n % 2:
            b = (b + sign * _round(key, n, a, high, tweak)) % high
        else:
            a = (a + sign * _round(key, n, b, low, tweak)) % low
    return a * high + b


def _walked(digits: str, key: bytes, tweak: bytes, like: Callable[[str], object], back: bool = False) -> str:
    """``digits`` permuted among all of their length for which ``like`` gives the same: other results are permuted on."""
    n, kind, value = len(digits), like(digits), int(digits)
    low, high = 10 ** (n // 2), 10 ** (n - n // 2)
    while True:
        value = feistel(value, low, high, key, tweak, back=back)
        out = f"{value:0{n}d}"
        if like(out) == kind:
            return out


def _letters(text: str, key: bytes, tweak: bytes, back: bool) -> str:
    value = 0
    for c in text:
        value = value * 26 + ord(c) - 65
    n, out = len(text), ""
    value = feistel(value, 26 ** (n // 2), 26 ** (n - n // 2), key, tweak, back=back)
    for _ in text:
        value, c = divmod(value, 26)
        out = chr(65 + c) + out
    return out


# Check rules of public standards: the body, and what follows from it.
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _iso_7064(body: str) -> str:
    p = 10
    for c in body:
        p = ((int(c) + p) % 10 or 10) * 2 % 11
    return str((11 - p) % 10)


def _ssn_like(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


_RULES: tuple[tuple[str, re.Pattern, Callable[[str], str], Callable[[str], object]], ...] = (
    # name, body and check of the number without separators, check of a body, what a body must keep
    ("dni", re.compile(r"()(\d{8})([A-Z])$"), lambda body: _DNI_LETTERS[int(body) % 23], lambda d: None),
    ("nie", re.compile(r"([XYZ])(\d{7})([A-Z])$"), lambda body: _DNI_LETTERS[int(body) % 23], lambda d: None),
    ("nir", re.compile(r"()([12]\d{12})(\d\d)$"), lambda body: f"{97 - int(body) % 97:02d}", lambda d: (d[0], "01" <= d[3:5] <= "12")),
    ("steuer-id", re.compile(r"()([1-9]\d{9})(\d)$"), _iso_7064, lambda d: d[0] != "0"),
    ("ssn", re.compile(r"()(\d{9})()$"), lambda body: "", _ssn_like),
)


def _rule(plain: str) -> tuple | None:
    """The rule that a number without separators meets, with its parts."""
    for name, shape, check, keep in _RULES:
        m = shape.match(plain)
        if m:
            body = {"X": "0", "Y": "1", "Z": "2"}.get(m[1], "") + m[2]
            if check(body) == m[3] and (name != "ssn" or _ssn_like(m[2])):
                return name, m[1], m[2], m[3], check, keep
    return None


def validated(number: str) -> str | None:
    """The public check rule that an identity number meets, or null."""
    found = _rule(re.sub("[^0-9A-Z]", "", number))
    return found[0] if found else None


def _permuted_id(plain: str, key: bytes, back: bool) -> str:
    """A valid number becomes another valid one of its kind, an invalid one another invalid one of its shape."""
    rule = _rule(plain)
    if rule:
        name, prefix, body, _, check, keep = rule
        body = _walked(body, key, b"id|" + name.encode() + prefix.encode(), keep, back)
        return prefix + body + check({"X": "0", "Y": "1", "Z": "2"}.get(prefix, "") + body)
    shape = re.sub("[A-Z]", "A", re.sub("[0-9]", "9", plain)).encode()
    while True:
        for places, change in (("[0-9]", lambda d: _walked(d, key, b"id|9" + shape, lambda x: None, back)), ("[A-Z]", lambda d: _letters(d, key, b"id|A" + shape, back))):
            held = re.findall(places, plain)
            if held:
                new = iter(change("".join(held)))
                plain = re.sub(places, lambda _: next(new), plain)
        if not _rule(plain):
            return plain


#: Calling codes of one and of two digits (the rest have three).
_CODE_1, _CODE_2 = "17", frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _national(text: str) -> list[int]:
    """Places of the digits of a phone number behind calling code and trunk digit, which a number has in some spellings only."""
    places = [i for i, c in enumerate(text) if c in "0123456789"]
    digits = "".join(text[i] for i in places)
    skip = 0
    if text.startswith("+") or digits.startswith("00"):
        skip = 0 if text.startswith("+") else 2
        rest = digits[skip:]
        skip += 1 if rest[:1] in _CODE_1 else 2 if rest[:2] in _CODE_2 else 3
    elif len(digits) == 11 and digits[0] == "1":
        skip = 1
    if digits[skip : skip + 1] == "0":
        skip += 1
    return places[skip:]


_FIRST_DAY, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


def read_date(text: str) -> tuple[date, str] | None:
    """A date of 1900 to 2099 and its order of parts, or null for what is none; day before month where both are possible."""
    parts = [int(x) for x in re.split(r"[./\-]", text)]
    for order in ("ymd",) if len(re.split(r"[./\-]", text)[0]) == 4 else ("dmy", "mdy"):
        try:
            found = date(*(parts[order.index(c)] for c in "ymd"))
        except ValueError:
            continue
        if 1900 <= found.year < 2100:
            return found, order
    return None


def _permuted_date(text: str, key: bytes, back: bool) -> str:
    found, order = read_date(text)
    value = found.toordinal() - _FIRST_DAY
    while True:
        value = feistel(value, 270, 271, key, b"date", back=back)
        new = date.fromordinal(_FIRST_DAY + value) if value < _DAYS else None
        # 3/4 may be read both ways: such dates stay among each other
        if new and (order == "ymd" or (new.day <= 12) == (found.day <= 12)):
            break
    parts = iter({"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}[c] for c in order)
    return re.sub(r"\d+", lambda _: next(parts), text)


def permuted(kind: str, text: str, key: bytes, back: bool = False) -> str:
    """A number or date of its kind, permuted under a key; the separators stay.

    What is permuted is the value without its spelling (national digits of a phone
    number, an identity number without separators, a day), so one value in several
    spellings stays linked. Valid check digits stay valid.
    """
    if kind == "date":
        return _permuted_date(text, key, back)
    if kind == "phone":
        places = _national(text)
        new = _walked("".join(text[i] for i in places), key, b"phone", lambda d: (d[0] == "0", len(d) == 11 and d[0] == "1"), back) if places else ""
    else:
        places = [i for i, c in enumerate(text) if c in "0123456789" or "A" <= c <= "Z"]
        new = _permuted_id("".join(text[i] for i in places), key, back) if places else ""
    out = list(text)
    for i, c in zip(places, new):
        out[i] = c
    return "".join(out)


def pseudonym(kind: str, text: str, key: bytes) -> str:
    """Typed placeholder: numbers and dates within their format, all else by a keyed tag of the value."""
    if kind in ("phone", "id_number", "date"):
        return f"<{kind}:{permuted(kind, text, key)}>"
    same = " ".join(text.split()).casefold()
    return f"<{kind}:{hmac.new(key, (kind + same).encode('utf-8', 'surrogatepass'), hashlib.sha256).hexdigest()[:10]}>"


@lru_cache(maxsize=2)
def _finder(names: tuple[str, ...]) -> Finder:
    return Finder(names)


def redacted(documents: DataFrame, given_names: DataFrame | None = None, key: str = DEFAULT_KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text, findings)``: the text with placeholders, otherwise unchanged, and what was found.

    ``findings`` is an array of ``(kind, pii_text, start, placeholder)`` by
    position in characters. One number or date has one pseudonym in all documents
    and spellings, because the keyed permutation depends on its value alone. The list of
    given names is a parameter of the operator (some thousands of entries; more
    than MAX_GIVEN_NAMES are refused). Null text stays null without findings;
    texts of any length are read whole; every document is worked on alone, so
    nothing is shuffled.
    """
    names: tuple[str, ...] = ()
    if given_names is not None:
        rows = given_names.select("given_name").where("given_name is not null").distinct().limit(MAX_GIVEN_NAMES + 1).collect()
        if len(rows) > MAX_GIVEN_NAMES:
            raise ValueError(f"more than {MAX_GIVEN_NAMES} given names")
        names = tuple(sorted(r[0] for r in rows))
    secret = hashlib.sha256(key.encode()).digest()
    finding = pa.struct([("kind", pa.string()), ("pii_text", pa.string()), ("start", pa.int32()), ("placeholder", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(names)
        for batch in text_batches(batches, 4 << 20):
            texts, found = [], []
            for value in batch.column(1).to_pylist():
                if not value:
                    texts.append(value)
                    found.append([])
                    continue
                parts, rows, at = [], [], 0
                for a, b, kind in finder.find(value):
                    holder = pseudonym(kind, value[a:b], secret)
                    parts += (value[at:a], holder)
                    rows.append({"kind": kind, "pii_text": value[a:b], "start": a, "placeholder": holder})
                    at = b
                texts.append("".join(parts) + value[at:])
                found.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(found, pa.list_(finding))], names=["doc_id", "text", "findings"])

    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text string, findings array<struct<kind:string,pii_text:string,start:int,placeholder:string>>")


KINDS = ("email", "phone", "id_number", "address", "name")


def findings(redactions: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """``(doc_id, kind, pii_text)`` of the kinds asked for, each once; dates of birth are found and replaced, but are none of the five."""
    found = redactions.select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.kind", "f.pii_text")
    return found.where(F.col("kind").isin(*kinds)).distinct()
