"""Personal information in free text: emails, phone numbers, identity numbers, street addresses and names.

Patterns propose spans with a score; checksums and the words around them raise or lower it; spans that reach the threshold
are taken, the surer kind first, and do not overlap.

Checksums: a Spanish document number whose letter is wrong is none, labelled or not; a French social security number (mod 97) or German
tax number (mod 11) without a label counts only if its check holds, and with a weak label too; what Luhn's sum confirms as a card number or
mod 97 as a bank account is neither a phone nor an identity number; a number whose parts are never given out (area 000 or 666, group 00,
serial 0000, one digit throughout) is no social security number. A strong label outweighs a failing check of the French and German numbers, as people mistype them.

Names are told by shape (two to four capitalised words that are no firm's, place's or office's) and context: titles, verbs of speech,
roles, signatures and contact details before or behind. A list of common given names is one more sign, not a condition.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import spread

KINDS = ("email", "phone", "id_number", "address", "name")
THRESHOLD = 0.5
#: What a name's shape, a listed given name, a cue before it, one that is weak, and a word behind it add to its score.
SHAPE, LISTED, CUE, WEAK_CUE, BEHIND = 0.3, 0.5, 0.35, 0.2, 0.3

# Common given names of the languages at hand.
_GIVEN = """
Adam Adrian Agnes Ahmed Aisha Alan Albert Alexander Alice Amara Amelia Amina Ana Andrea Andrew Anita Anna Anne Anselm Antoine Anton Antonio Arthur
Astrid Barbara Beatrice Ben Benjamin Bram Bruno Camille Carla Carlos Caroline Catherine Celia Charles Charlotte Chloe Christian Christine Claire Clara
Claude Daniel David Deborah Denis Diana Diego Dieter Dmitri Edward Elena Elias Elisabeth Elizabeth Emil Emma Eric Erik Ernst Esther Eva Farid Fatima
Felix Fernando Florian Francesca Francis Franz Frederik Gabriel George Georg Giulia Greta Guillaume Gustav Hana Hannah Hans Harold Helen Helena Henrik Henry
Hugo Ibrahim Ilse Inga Ingrid Irene Isabel Ivan Ivo Jacques Jakob James Jan Jane Javier Jean Jens Joan Joanna Johannes John Jonas Jorge Jose Julia Julien Karen
Karl Katharina Keiko Klaus Lars Laura Leila Lena Leo Lina Linda Louis Lucas Lucia Luis Luisa Mara Marco Margaret Maria Marie Marek Mark Marta Martin Mary Matthias
Maurice Mehmet Michael Miguel Milo Mohammed Monika Nadia Natalia Nicolas Nina Noor Olga Oliver Omar Oscar Oskar Pablo Patricia Paul Paula Paulo Pedro Peter Petra
Philip Pierre Priya Quentin Rachel Rafael Renata Richard Robert Rosa Ruben Samuel Sandra Sara Simon Sofia Sophie Stefan Susan Sven Tamsin Teresa Thomas Tilda
Tobin Ulrich Victor Viktor Vincent Wanda Werner William Wolfgang Yasmin Yusuf Yves Zara Zoë Zoe Émile Éric André José François René Jürgen Günter Søren
""".split()
# Words that end a firm's or fund's name, and that begin sentences but no surname.
_FIRM = r"(?:plc|ltd|llc|llp|inc|corp|corporation|company|co|group|holdings?|capital|bancorp|bank|energy|partners|materials|industries|logistics|fund|trust|sons|ag|sa|nv|gmbh|se|lp|kg|street|road|avenue|harbour)"
_NO_SURNAME = set("""the a an and of in on at by for from to with signed according contact tel fax mr mrs ms dr he she it a copy please complaints participants series order version unit
file shareholder between follow invoice accession tax selon siège signé écrire le la les un une der die das ein eine el los las laut frau herr gez dear chief who sir madam
plc ltd inc corp group holdings capital bancorp energy partners materials industries logistics fund trust ag sa nv gmbh lp sons""".split())

_MOJI = "[ÃÂÅ][\x80-\xbf–-›€™ŒœŠšŸŽžƒˆ˜]"
_L = rf"(?:{_MOJI}|[^\W\d_])"
_AP = r"(?:['’]|&#39;|&rsquo;|&apos;)"
_SP = r"(?:&nbsp;|\s){1,4}"
_ONE = rf"(?:(?:[ODLdl]{_AP}|Mac|Mc|MC|MAC|[aA][lL]-|[eE][lL]-)?(?:{_MOJI}|[A-ZÀ-ÖØ-ÞŠŽŁŚŻČŘ]){_L}+)"
_WORD = rf"{_ONE}(?:-{_ONE})*"
_PARTICLE = rf"(?:(?:[vV][aA][nN]|[vV][oO][nN]|[dD][eE][rRnNlL]?|[dD][aAiIuU]|[dD]os|[lL][aAeE]|[eE]l|[bB]in|[tT]en|[tT]er|[zZ]u){_SP})"
_SURNAME = rf"(?:{_PARTICLE}{{0,3}}{_WORD})"
_INITIAL = rf"(?:[A-ZÀ-ÖØ-Þ]\.(?:{_SP})?)"
_NAME_AFTER = re.compile(rf"(?:-{_ONE})*{_SP}(?:{_INITIAL}){{0,3}}(?P<s>{_SURNAME})")
_NAME_BEFORE = re.compile(rf"(?<![\w-])(?P<s>{_SURNAME}),{_SP}$")
_MIDDLE = re.compile(rf"(?:-{_ONE})*(?:{_SP}{_INITIAL}(?!\w))*")
_LONE = re.compile(r"[A-ZÀ-ÖØ-Þ]\.")
_INITIALS = re.compile(rf"(?P<i>{_INITIAL}{{1,4}})(?P<s>{_SURNAME})")
_MORE_INITIALS = re.compile(rf"[A-Z]\.(?:(?:{_SP})?[A-Z]\.)*(?=[\s,.;)]|$)")
# Words before a name: titles, speech, signatures, contacts, holders, roles; and words that make one likely.
_TITLES = ("mr.", "mrs.", "ms.", "mr", "mrs", "ms", "miss", "dr.", "dr", "prof.", "professor", "sir", "dame", "rev.", "m.", "d.", "mme", "mlle", "don", "doña", "sr.", "sra.", "señor", "señora", "frau", "herr", "herrn", "madame", "monsieur", "maître")
_CUES = _TITLES + (
    "said", "says", "told", "asked", "thanked", "according to", "selon", "laut", "según", "/s/", "gez.", "signed by", "signed:", "signé :", "signé par", "firmado:", "firmado por", "unterzeichnet:", "sincerely,", "regards,", "prepared by", "written by", "reviewed by", "approved by", "appointed", "elected",
    "contact:", "contact", "contacts:", "attn:", "attention:", "c/o", "enquiries:", "ask for", "speak to", "write to", "call", "contact presse :", "contacto:", "pressekontakt:", "ansprechpartner:", "ansprechpartnerin:", "name:", "name of", "named", "names", "nom :", "nombre:", "holder", "shareholder", "employee", "beneficiary",
    "claimant", "witness", "applicant", "tenant", "patient", "owner", "colleague", "inhaber", "inhaberin", "titulaire", "salarié", "titular", "empleado", "chairman", "chairwoman", "chair", "president", "director", "secretary", "analyst", "spokesman", "spokeswoman", "spokesperson", "minister", "governor", "judge", "auditor", "notary", "lawyer",
    "attorney", "manager", "executive", "officer", "editor", "geschäftsführer", "geschäftsführerin", "vorstand", "sprecher", "sprecherin", "directeur", "directrice", "président", "présidente", "portavoz", "directora",
)
_WEAK_CUES = ("with", "by", "between", "and", "from", "avec", "par", "mit", "von", "con", "por")
# Words behind a name.
_AFTER = ("said", "says", "told", "added", "wrote", "joined", "resigned", "abstained", "retired", "died", "left", "leads", "was appointed", "was elected", "was named", "has been", "will succeed", "succeeds", "who", "chief", "director", "chair", "chairman", "president", "head of", "managing", "analyst", "aged", "born", "tel.", "tel", "on +", "a démissionné", "a déclaré",
          "directeur", "directrice", "demeurant", "dit", "dejó", "declaró", "dijo", "directora", "con domicilio", "nacido", "nacida", "verlässt", "erklärte", "sagte", "wohnhaft", "geboren", "vorstand", "geschäftsführer", "leiter", "leiterin", "né le", "née le")
_PARTICLES = {"van", "von", "de", "del", "der", "den", "dem", "dos", "da", "di", "du", "la", "le", "las", "los", "el", "al", "bin", "ten", "ter", "zu"}
_OFFICES = set("""office offices relations department board committee council ministry desk team service services press investor investors media public affairs customer customers general annual report management
january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday north south east west united new saint bank central european federal national royal
university institute agency authority commission court parliament union association society foundation school college hospital bulletin wire gazette review news online segment segments market markets house church museum international chief executive officer director financial main
this that these those his her our their your we they i our one two three all each every no not after before when while if as since until once upon under over despite although however""".split())
_CUE_END = re.compile(rf"(?:{'|'.join(re.escape(w) for w in sorted(_CUES, key=len, reverse=True))})(?:{_SP})?$", re.I)
_GIVEN_SHAPE = rf"{_ONE}(?:-(?:{_ONE}|[a-z]{{2,}}))*"
_SHAPED = re.compile(rf",?{_SP}(?:(?:Mr|Mrs|Ms|Dr|Mme|M|D|Prof|Frau|Herr)\.?{_SP})?(?P<n>{_GIVEN_SHAPE} {_WORD} {_WORD}(?=[,.;:)]|\s[a-z(]|\s*$)|{_GIVEN_SHAPE}(?:{_SP}{_INITIAL})*{_SP}{_SURNAME}|{_SURNAME},{_SP}{_WORD})(?![\w-]|{_SP}(?:&|{_FIRM}\b))")
_SHAPED_BEFORE = re.compile(rf"(?<![\w.&'’-])(?P<n>{_GIVEN_SHAPE}(?: {_WORD}|(?:{_SP}{_INITIAL})*){_SP}{_SURNAME}|{_SURNAME},{_SP}{_WORD})(?:,|{_SP}\(|,?{_SP})$")
_IN_TITLE = re.compile(rf"{_WORD}{_SP}$")
_FOLLOWED_BY_FIRM = re.compile(rf"{_SP}(?:&|{_FIRM}\b)", re.I)

_AT = r"(?:@|\s@\s|\s?[\[({]\s?at\s?[\])}]\s?|\sAT\s|&#64;)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sDOT\s)"
_EMAIL = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9](?:[\w.+%-]*[\w+%-])?{_AT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*{_DOT}[A-Za-z]{{2,24}}(?![\w-])", re.A)
_BRACKETED_AT = re.compile(r"[\[({]\s?at\s?[\])}]")

_S = r"[ \xa0./–-]"
_PHONE = re.compile(
    rf"(?<![\w+])(?<![\d][ .,/–:-])(?:"
    rf"(?:\+|00)[1-9]\d{{0,2}}{_S}?(?:\(0\){_S}?)?(?:\(\d{{1,5}}\){_S}?)?\d(?:{_S}?\d){{6,11}}"
    rf"|(?:1{_S})?\(\d{{3}}\){_S}?\d{{3}}{_S}?\d{{4}}"
    rf"|(?:1{_S})?[2-9]\d{{2}}(?P<sep>[ .-])\d{{3}}(?P=sep)\d{{4}}"
    rf"|\(0\d{{1,5}}\){_S}?\d(?:{_S}?\d){{4,9}}"
    rf"|0[1-9]\d?(?:{_S}?\d){{7,10}}"
    rf")(?![\w–-]|[.,:/]\d)"
)
_NOT_PHONE = re.compile(r"(?:\b(?:no|nr|ref|file|order|series|cik|accession|invoice|version|account|isin|exhibit|annex|page|id|vat|siren|siret)\b\.?:? ?#?|(?:[$€£]|\bEUR|\bUSD|\bGBP) ?|(?-i:\b[A-Z]{2}\d* ?))$", re.I)

# Words that label an identity number.
_LABELS = ("social security", "national insurance", "national id", "identity", "taxpayer", "tax id", "tax number", "tax reference", "id on file", "passport", "driving licence", "ssn", "nino", "itin", "tin", "curité sociale", "curitã© sociale", "numéro fiscal", "carte d'identité",
           "passeport", "nir", "documento", "pasaporte", "seguridad social", "dni", "nie", "nif", "ausweisnummer", "ausweis", "reisepass", "reisepassnummer", "personalausweis", "steuer-id", "steuerid", "steuernummer", "sozialversicherungsnummer")
#: Labels that leave room for doubt; a number behind them must not fail its check.
_WEAK_LABELS = ("nir", "nif", "tin", "id on file", "documento", "identity")
_LABEL = re.compile(r"(?:\s+(?:number|nummer|id|no|nr|n°|nº|n[uú]m(?:ero)?)\b)?\.?\s*(?:as|is|was|:|=|#|n°|nº)?\s*(?=[A-Z0-9])", re.I)
_D = r"[ \xa0–-]?"
_NUMBER = re.compile(
    rf"\d{{2}}\.?\d{{3}}\.?\d{{3}}{_D}[A-Za-z](?!\w)|[XYZ]{_D}\d{{7}}{_D}[A-Z](?!\w)|[12]{_D}\d{{2}}{_D}\d{{2}}{_D}(?:\d{{2}}|2[AB]){_D}\d{{3}}{_D}\d{{3}}(?:{_D}\d{{2}})?(?!\w)"
    rf"|[A-Z]{{2}}{_D}\d{{2}}{_D}\d{{2}}{_D}\d{{2}}{_D}[A-D](?!\w)|\d{{3}}{_D}\d{{2}}{_D}\d{{4}}(?!\d)|\d{{2}}{_D}\d{{3}}{_D}\d{{3}}{_D}\d{{3}}(?!\d)|\d{{2}}{_D}\d{{6}}{_D}[A-Z]{_D}\d{{3}}(?!\w)"
    rf"|[A-Z]{{1,3}}{_D}[A-Z0-9]*\d[A-Z0-9]*(?:{_D}[A-Z0-9]*\d[A-Z0-9]*)*|\d(?:{_D}\d){{5,14}}{_D}[A-Z]?(?!\w)", re.A,
)
_DIGITS = re.compile(r"[+(]?\d(?:[ \xa0./()–-]{0,3}\d){6,}")
_BARE = re.compile(r"(?<![\w.,-])(?:\d{8}-?[A-Z]|\d{2}\.\d{3}\.\d{3}-?[A-Z]|[12]( ?)\d{2}\1\d{2}\1\d{2}\1\d{3}\1\d{3}\1\d{2}|[1-9]\d( ?)\d{3}\2\d{3}\2\d{3})(?![\w-])", re.A)

_TYPE = r"(?:street|st\b\.?|road|rd\b\.?|avenue|ave\b\.?|lane|ln\b\.?|drive|dr\b\.?|court|ct\b\.?|way|terrace|parkway|pkwy\b\.?|boulevard|blvd\b\.?|close|crescent|square|row|hill|gardens|grove|walk|mews|highway|hwy\b\.?|circle|place|pl\b\.?|plaza)"
_UNIT = r"(?:(?:flat|apartment|apt\.?|unit|suite|room|floor|ste\.?)\s#?\d{1,5}[a-z]?,?\s+)"
_STREET = (
    re.compile(rf"(?<![\w.,:–-]){_UNIT}?\d{{1,5}}[a-z]?,?\s+(?:(?:north|south|east|west|n|s|e|w|ne|nw|se|sw)\.?\s+)?(?:{_L}[\w'’-]+\s+){{1,3}}?{_TYPE}(?!\w)(?!\s+(?:lending|window))", re.I),
    re.compile(rf"(?<![\w.,:–-])\d{{1,4}}(?:\s?(?:bis|ter|quater|[a-d])\b)?,?\s+(?:rue|avenue|av\.|boulevard|bd\.?|place|allée|all.{{1,2}}e|chemin|quai|impasse|cours|route|square)\s+(?:(?:du|de la|des|de|d['’]|de l['’])\s*)?{_L}[\w'’-]+", re.I),
    re.compile(rf"(?<!\w)(?:C/|(?:calle|avda\.?|avenida|av\.|plaza|pza\.?|paseo|camino|ronda|travesía|carrera)(?!\w))\s*(?:(?:del|de la|de los|de las|de)\s+)?{_L}[\w'’-]+(?:\s{_L}[\w'’-]+)?,?\s+(?:(?:nº|n\.º|n°|núm\.?)\s*)?(?:\d{{1,5}}|s/n)(?!\w)", re.I),
    re.compile(rf"(?<![\w-])(?:(?:am|an der|an den|im|zum|zur|auf der|in der)\s+)?{_L}[\w-]*?(?:straße|strasse|straÃŸe|str\.|weg|platz|allee|gasse|ring|ufer|damm|chaussee|steig)\s+\d{{1,4}}\s?[a-z]?(?!\w)", re.I),
)
# What kind of street pattern (see _STREET) each word hints at.
_STREET_WORDS = {
    0: ("street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "drive", "dr", "court", "ct", "way", "terrace", "parkway", "pkwy", "boulevard", "blvd", "close", "crescent", "square", "row", "hill", "gardens", "grove", "walk", "mews", "highway", "hwy", "circle", "place", "pl", "plaza"),
    1: ("rue", "avenue", "av.", "boulevard", "bd", "bd.", "place", "allée", "allã©e", "chemin", "quai", "impasse", "cours", "route", "square"),
    2: ("c/", "calle", "avda", "avda.", "avenida", "av.", "plaza", "pza", "paseo", "camino", "ronda", "travesía", "carrera"),
    3: ("straße", "strasse", "straãÿe", "str.", "weg", "platz", "allee", "gasse", "ring", "ufer", "damm", "chaussee", "steig"),
}

#: What counts as a blank before a word.
_BLANKS = "\n\r\t\xa0(\"“„«[>"

_AUTOMATON: list = []
_WORDS: list = []


def _hints():
    """An automaton, for lowercased text, of the words that cue a name, label a number or belong to a street."""
    if not _WORDS:
        import ahocorasick

        found: dict[str, list] = {}
        for w in _CUES:
            found.setdefault(w, []).append("cue")
        for w in _WEAK_CUES:
            found.setdefault(w, []).append("weak")
        for w in _AFTER:
            found.setdefault(w, []).append("after")
        for w in _LABELS:
            found.setdefault(w, []).append("label")
        for k, words in _STREET_WORDS.items():
            for w in words:
                found.setdefault(w, []).append(k)
        a = ahocorasick.Automaton()
        for w, kinds in found.items():
            free = 3 in kinds or "label" in kinds or not w[0].isalnum()  # may stand within a word
            closed = w[-1].isalpha() and all(k in ("cue", "weak") for k in kinds)  # a blank follows
            tails = (" ", ",") if closed else (" ", ".", ",", ";", ")", "<") if len(w) == 2 and not free else ("",)
            for tail in tails:
                a.add_word(" " * (not free) + w + tail, (len(w), len(tail), w[-1].isalpha(), tuple(kinds), w in _WEAK_LABELS))
        a.make_automaton()
        _WORDS.append(a)
    return _WORDS[0]


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _given_names():
    """An automaton of the given names as written, in capitals, and with their UTF-8 read as Latin."""
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for n in _GIVEN:
            for form in (n, n.upper()):
                a.add_word(form, len(form))
                if not form.isascii():
                    broken = form.encode().decode("cp1252", "replace")
                    a.add_word(broken, len(broken))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def dni_letter(number: str) -> bool:
    """Whether the letter of a Spanish document number fits its digits."""
    digits = re.sub(r"\D", "", number)
    return len(digits) == 8 and "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == number[-1].upper()


def nir_key(number: str) -> bool:
    """Whether the last two digits of a French social security number are 97 less the rest modulo 97."""
    digits = re.sub(r"\D", "", number)
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def tax_id(number: str) -> bool:
    """Whether the last digit of a German tax number is its check by mod 11, 10, and one digit alone comes twice or three times in the ten before."""
    digits = re.sub(r"\D", "", number)
    if len(digits) != 11 or digits[0] == "0" or sorted(n for d in set(digits[:10]) if (n := digits[:10].count(d)) > 1) not in ([2], [3]):
        return False
    product = 10
    for d in digits[:10]:
        product = ((int(d) + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10 == int(digits[10])


def given_out(number: str) -> bool:
    """Whether the parts of an American social security number are such as are given out, or of an invented one: no area 000 or 666, group 00, serial 0000 or one digit throughout."""
    d = re.sub(r"\D", "", number)
    return not (d[:3] in ("000", "666") or d[3:5] == "00" or d[5:] == "0000" or len(set(d)) == 1)


def iban(number: str) -> bool:
    """Whether the check digits of a bank account number hold (mod 97)."""
    s = re.sub(r"[\W_]", "", number).upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


#: Forms of identity numbers that have a check, the check, and how much its failing takes from a labelled number's score.
_CHECKS = (
    (re.compile(r"\d{2}\.?\d{3}\.?\d{3}[ –-]?[A-Za-z]$"), "dni_letter", 0.5),
    (re.compile(r"[12](?:[ \xa0–-]?\d){14}$"), "nir_key", 0.3),
    (re.compile(r"\d{2}[ \xa0–-]?\d{3}[ \xa0–-]?\d{3}[ \xa0–-]?\d{3}$"), "tax_id", 0.3),
    (re.compile(r"\d{3}[ \xa0–-]?\d{2}[ \xa0–-]?\d{4}$"), "given_out", 0.5),
)
_ACCOUNT = re.compile(r"[A-Z]{2}\d{2}(?:[ \xa0-]?[A-Z0-9]{1,4}){3,9}", re.A)


def _check(number: str) -> tuple[bool, float]:
    """Whether the number has a check that holds, and what one that fails costs."""
    for form, name, cost in _CHECKS:
        if form.match(number):
            holds = globals()[name](number)
            return holds and name != "given_out", 0.0 if holds else cost
    return False, 0.0


def _card(digits: str) -> bool:
    """Whether a run of digits is a card number."""
    d = re.sub(r"\D", "", digits)
    return 13 <= len(d) <= 19 and d[0] in "3456" and luhn(d)


def luhn(number: str) -> bool:
    digits = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def _is_surname(s: str) -> bool:
    return re.split(r"\s|&nbsp;", s)[-1].lower() not in _NO_SURNAME


def _names(text: str):
    end = -1
    for last, size in _given_names().iter(text):
        i, j = last - size + 1, last + 1
        if i < end or i and (text[i - 1].isalnum() or text[i - 1] in "_@&") or j < len(text) and (text[j].isalnum() or text[j] in "_@"):
            continue
        if i and text[i - 1] == "-" and i > 1 and text[i - 2].isalpha():  # second half of a double surname or name
            continue
        after = _NAME_AFTER.match(text, j)
        if after and (not _is_surname(after["s"]) or _FOLLOWED_BY_FIRM.match(text, after.end())):
            after = None
        before = _NAME_BEFORE.search(text, max(0, i - 70), i)
        if before and (not _is_surname(before["s"]) or before["s"][:1].isspace()):
            before = None
        if before and (not after or _CUE_END.search(text, max(0, before.start() - 40), before.start())):
            end = _MIDDLE.match(text, j).end()
            yield before.start(), end, SHAPE + LISTED
        elif after:
            end = after.end()
            yield i, end, SHAPE + LISTED
    end = -1
    for lone in _LONE.finditer(text):
        at = lone.start()
        if at < end or at and (text[at - 1].isalnum() or text[at - 1] in ".&_'’"):
            continue
        m = _INITIALS.match(text, at)
        if m and _is_surname(m["s"]) and not _FOLLOWED_BY_FIRM.match(text, m.end()):
            start, letters = at, re.findall(r"\w", m["i"])
            end = m.end()
            if letters[0] in "MD" and re.match(r",?\s+(?:demeurant|con domicilio)", text[m.end() : m.end() + 16]):
                if len(letters) == 1:  # a title; the surname stands alone
                    continue
                start += re.match(rf"\w\.(?:{_SP})?", m["i"]).end()
                letters = letters[1:]
                yield start, m.end(), 0.7
                continue
            if len(letters) == 1 and letters[0] in "MD" and re.match(rf"{_SP}(?:{_INITIAL}{_SP})?{_PARTICLE}{{0,3}}{_WORD}", text[m.end() : m.end() + 40]):  # a title before a full name
                continue
            cued = len(letters) > 1 or _CUE_END.search(text, max(0, start - 40), start)
            yield start, m.end(), 0.7 if cued else 0.3
        elif at > 2 and text[at - 1].isspace():
            before = _NAME_BEFORE.search(text, max(0, at - 70), at)
            if before and _is_surname(before["s"]) and _CUE_END.search(text, max(0, before.start() - 40), before.start()):
                m = _MORE_INITIALS.match(text, at)
                if m:
                    end = m.end()
                    yield before.start(), end, 0.7


def _bearers(name: str) -> bool:
    """Whether the words of a name, but for particles, are two at least and none of a firm or office."""
    words = [w for w in re.split(rf"{_SP}|,", name) if w and w.lower() not in _PARTICLES]
    return len(words) > 1 and not any(w.lower() in _NO_SURNAME or w.lower() in _OFFICES or re.fullmatch(_FIRM, w, re.I) for w in words)


def _person(text: str, m: re.Match) -> bool:
    """Whether a shape that fits a name is none of a firm, place or office."""
    return _bearers(m["n"]) and not _FOLLOWED_BY_FIRM.match(text, m.end("n")) and not re.match(rf"{_SP}[A-Z]\w+{_SP}(?:Ltd|plc|Inc|LP|AG|SA|NV|Corp)\b", text[m.end("n") : m.end("n") + 40])


def _cued(text: str, at: int, weak: bool):
    m = _SHAPED.match(text, at)
    if m and _person(text, m) and not (weak and not re.match(r"[.,;)]|\s[a-z(]|\s*$", text[m.end("n") : m.end("n") + 2])):
        yield m.start("n"), m.end("n"), "name", SHAPE + (WEAK_CUE if weak else CUE)


def _followed(text: str, at: int):
    """Names right before ``at``, where a word that follows names begins."""
    m = _SHAPED_BEFORE.search(text, max(0, at - 70), at)
    if m and _person_before(text, m):
        yield m.start("n"), m.end("n"), "name", SHAPE + BEHIND


def _person_before(text: str, m: re.Match) -> bool:
    if _IN_TITLE.search(text, max(0, m.start() - 30), m.start()) and not _CUE_END.search(text, max(0, m.start() - 40), m.start()):
        return False
    return _bearers(m["n"])


def _ats(text: str) -> list[int]:
    """Where an at sign stands, in any of its spellings."""
    places = []
    for sign in ("@", "&#64;", "AT"):
        at = text.find(sign)
        while at >= 0:
            if sign != "AT" or at and text[at - 1].isspace() and text[at + 2 : at + 3].isspace():
                places.append(at)
            at = text.find(sign, at + 1)
    if "[" in text or "(" in text or "{" in text:
        places += [m.start() for m in _BRACKETED_AT.finditer(text)]
    return sorted(places)


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The bank account number that stands at ``at`` or begins up to four characters before, if its check holds."""
    for begin in {at, at - 2, at - 4}:
        m = _ACCOUNT.match(text, begin) if begin >= 0 else None
        while m and not iban(m.group()):  # a shorter one may hold
            cut = max(m.group().rfind(c) for c in " \xa0-")
            m = _ACCOUNT.fullmatch(text, begin, begin + cut) if cut > 0 else None
        if m:
            return m.span()
    return None


def _proposals(text: str):
    end = 0
    for at in _ats(text):
        i = at - (at > 0 and text[at - 1].isspace())
        j = i
        while j > end and (text[j - 1].isascii() and text[j - 1].isalnum() or text[j - 1] in "_.+%-"):
            j -= 1
        if j < i and (m := _EMAIL.match(text, j)):
            end = m.end()
            yield j, end, "email", 0.95
    for run in _DIGITS.finditer(text):
        a, b = run.span()
        if text[a] not in "+(0" and _card(run.group()):
            continue
        for m in _PHONE.finditer(text, a, min(len(text), b + 6)):
            s, score = m.group(), 0.8
            if _NOT_PHONE.search(text, max(0, m.start() - 14), m.start()):
                score -= 0.5
            if b - a > 14 and (account := _account(text, a)) and account[0] < m.end() and m.start() < account[1]:
                score -= 0.5
            yield m.start(), m.end(), "phone", score
        for m in _BARE.finditer(text, a, min(len(text), b + 3)):
            s = m.group()
            yield m.start(), m.end(), "id_number", 0.6 if _check(s)[0] else 0.2
    low = _lower(text).replace("&nbsp;", "      ")
    for c in _BLANKS:
        low = low.replace(c, " ")
    for last, (size, tail, wordy, kinds, doubtful) in _hints().iter(f" {low} "):
        j = last - tail
        i = j - size
        if wordy and j < len(text) and (text[j].isalnum() or text[j] == "_"):
            continue
        inside = i and text[i - 1].isalnum()
        for kind in kinds:
            if kind == "label" and not (inside and text[i].isascii() and text[i] != "c"):
                label = _LABEL.match(text, j)
                n = label and _NUMBER.match(text, label.end())
                if n and sum(c.isdigit() for c in n.group()) >= 6 and not _account(text, n.start()) and not _card(n.group()):
                    holds, cost = _check(n.group())
                    yield n.start(), n.end(), "id_number", 0.95 if holds else (0.7 if doubtful else 0.9) - cost
            elif (kind == "cue" or kind == "weak" and text[i].islower()) and not inside:
                yield from _cued(text, j, kind == "weak")
            elif kind == "after" and not inside and i and text[i - 1] in " \xa0\n(":
                yield from _followed(text, i)
            elif kind == 3 or kind in (0, 1, 2) and not inside:
                for m in _STREET[kind].finditer(text, max(0, i - 80), min(len(text), j + 60)):
                    if m.start() <= i and j <= m.end() + 1:
                        yield m.start(), m.end(), "address", 0.7
    for i, j, score in _names(text):
        yield i, j, "name", score


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal information in ``text``, in order, without overlaps; none in null or empty text."""
    if not text:
        return []
    taken: list[tuple[int, int, str]] = []
    ranked = sorted((p for p in _proposals(text) if p[3] >= THRESHOLD), key=lambda p: (KINDS.index(p[2]) if p[2] != "id_number" else 0.5, -p[3], p[0], -p[1]))
    for start, end, kind, _ in ranked:
        if all(end <= a or start >= b for a, b, _ in taken):
            taken.append((start, end, kind))
    return sorted(taken)


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) with ``spans``: array of start (from 0), end and kind."""

    @F.arrow_udf("array<struct<start:int,end:int,kind:string>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("start", "end", "kind"), s)) for s in find_spans(t)] for t in texts.to_pylist()], pa.list_(SPAN))

    return spread(docs.select("id", "text")).select("id", "text", spans("text").alias("spans"))


def personal_information(docs: DataFrame) -> DataFrame:
    """(id, kind, pos) of every occurrence in ``docs`` (id, text), pos from 1. Null and empty texts have none."""
    return with_spans(docs).select("id", F.explode("spans").alias("s")).select("id", "s.kind", (F.col("s.start") + 1).alias("pos"))


def redact(docs: DataFrame) -> DataFrame:
    """(id, text, replaced): each text with typed placeholders such as [EMAIL] for what was found, all else unchanged; null stays null."""
    start, end = F.lit(1), F.size("spans")
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(F.col("spans"), i - 1)["end"])
    piece = F.transform("spans", lambda s, i: F.concat(F.substring(F.col("text"), before(i) + 1, s["start"] - before(i)), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    tail = F.substring(F.col("text"), F.coalesce(F.get(F.col("spans"), end - start)["end"], F.lit(0)) + 1, F.length("text"))
    return with_spans(docs).select("id", F.concat(F.array_join(piece, ""), tail).alias("text"), end.alias("replaced"))
