"""Shapes and cue words of the structured kinds of personal information (fixed values)."""

from __future__ import annotations

import re

# Patterns without A-Z run on the lower-case text: without re.I the regex engine can skip ahead by first characters.

# the sign of a mail address, its local part before (reversed search) and its domain behind
MAIL_SIGN = re.compile(r"@|[(\[{]at[)\]}]| at (?=\S+ dot )")
#: What a local part consists of; it is looked for from the first such character on, however long it is.
MAIL_INNER = frozenset("._+-%\u200b")
MAIL_LOCAL = re.compile(r"(?<![\w.+\-%])[\w%](?:[\w.+\-%\u200b]*[\w%])?\u200b?\s?$")
_DOT = r"(?:\u200b?\.\u200b?|\s?[(\[{]dot[)\]}]\s?|\sdot\s)"
MAIL_DOMAIN = re.compile(rf"\s?\u200b?[^\W\d_][\w\-]*(?:{_DOT}[^\W\d_][\w\-]*)*{_DOT}[^\W\d_]{{2,}}(?![\w@])")

_DIGIT_WORDS = {
    "en": "zero|oh|one|two|three|four|five|six|seven|eight|nine|double",
    "fr": "zéro|un|deux|trois|quatre|cinq|six|sept|huit|neuf",
    "de": "null|eins|zwei|zwo|drei|vier|fünf|sechs|sieben|acht|neun",
    "es": "cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve",
}
_WORDS = "|".join(dict.fromkeys("|".join(_DIGIT_WORDS.values()).split("|")))
SPELLED = re.compile(rf"(?<!\w)(?:(?:{_WORDS})[\s\-,]+){{6,}}(?:{_WORDS})(?!\w)")
_S = r"(?:\s?[\-‑–.]\s?|\s)"
_EXT = r"(?:,?\s?(?:ext|extension|x|poste|durchwahl|dw|extensión)\.?\s?\d{1,6}(?!\d))?"
#: Where a number of seven digits or more can be; a date alone is none.
DIGIT_RUN = re.compile(r"[+(\d][\d()\s.\-‑–/]{5,}\d")
DATE_ALONE = re.compile(r"(?:(?:\d{1,2}|\d{4})[\-/.]\d{1,2}[\-/.]\d{2,4}|\d{4})(?:\s\d{1,2})?")
_PHONE = "|".join(
    [
        # North American
        rf"(?<![\w.\-/+(])(?:\+?1{_S}?)?(?:\(\d{{3}}\)\s?|\d{{3}}{_S})\d{{3}}{_S}\d{{4}}(?![\-‑–./]?\w){_EXT}",
        rf"(?<![\w.\-/+(])\d{{10}}(?![\-‑–./]?\w){_EXT}",
        # international, groups of two or more digits
        rf"(?<![\w.\-/+(])(?:\+|00)\d{{1,3}}(?:{_S}?\(0\))?(?:{_S}?\d{{1,5}}){{2,6}}(?![\-‑–./]?\w){_EXT}",
        # France, Germany, Spain
        rf"(?<![\w.\-/+(])0\d(?:{_S}\d{{2}}){{4}}(?![\-‑–./]?\w){_EXT}",
        rf"(?<![\w.\-/+(])(?:\(0\d{{2,5}}\)\s?|0\d{{2,5}}[\s/\-])\d{{3,}}(?:[\s\-]\d{{2,}})*(?![\-‑–./]?\w){_EXT}",
        r"(?<![\w.\-/+(])[679]\d{2}(?:\s\d{2}){3}(?![\-‑–./]?\w)|(?<![\w.\-/+(])[89]\d\s\d{3}\s\d{2}\s\d{2}(?![\-‑–./]?\w)",
    ]
)

# identity numbers whose shape is enough, unless the word before gives another meaning
_B, _E = r"(?<![\w.\-–‑/+#(@])", r"(?![\-–‑./]?\w)"
_ID_WHOLE = "|".join(
    [
        rf"{_B}[12378]\s?\d{{2}}\s?(?:0[1-9]|1[0-2]|[2-9]\d)\s?(?:\d{{2}}|2[AB])\s?\d{{3}}\s?\d{{3}}\s?\d{{2}}{_E}",
        rf"{_B}\d{{2}}\s?\d{{6}}\s?[A-Z]\s?\d{{3}}{_E}",
        rf"{_B}\d{{8}}[\- ]?[A-HJ-NP-TV-Z](?![\w'’])",
        rf"{_B}\d{{3}}-\d{{3}}-\d{{3}}-[A-Z]{_E}",
        # in a row of a table, between other fields
        r"(?<=/ )\d{9}(?= /)",
    ]
)
# the capital comes first, so that the engine can skip to the next one
ID_LETTERED = re.compile(rf"[A-Z](?<![\w.\-–‑/+#(@].)(?:[A-Z]{{2,4}}-\d{{6}}|\d{{2}}[A-Z]\d{{2}}[A-Z]\d{{2}}|\d{{7,8}}|[A-Z]\d{{7}}){_E}")
_ID_SHAPE = rf"{_B}(?!000|666)\d{{3}}(?P<q>[\-–‑. ])(?!00)\d{{2}}(?P=q)(?!0000)\d{{4}}{_E}"
#: Numbers told by their shape, identity numbers first; on the lower-case text.  What all have in common comes first.
NUMBERS = re.compile(f"(?<![\\w.\\-/+(])(?=[+(\\d])(?:(?P<whole>{_ID_WHOLE.replace('[A-Z]', '[a-z]').replace('[A-HJ-NP-TV-Z]', '[a-hj-np-tv-z]').replace('2[AB]', '2[ab]')})|(?P<shape>{_ID_SHAPE})|(?P<phone>{_PHONE}))")
_NUMBER = r"(?P<id>(?=[\w\-–‑. ]*\d)[A-Z0-9]{1,4}(?:[\-–‑. ]?[A-Z0-9]*\d[A-Z0-9]*){0,6}(?:[\- ][A-Z])?)"
#: Words that announce an identity number.
CUES = [
    "ssn", "social security(?: (?:number|no\\.?))?", "social insurance(?: number)?", "id shown", "identity confirmed with", "national id(?: number)?",
    "mrn", "med(?:ical)?\\.? rec(?:ord)?\\.?(?: (?:number|no\\.?|#))?", "chart(?: (?:number|no\\.?|#))?", "record number", "patientennr\\.?", "patientennummer", "patienten-id",
    "passport(?: (?:number|no\\.?|is))?", "passeport(?: n[°ºo]\\.?)?", "reisepass(?:nr\\.?|nummer)?", "pasaporte(?: n\\.?º)?",
    "driver['’]?s['’]? licen[cs]e(?: (?:number|no\\.?))?", "driving licen[cs]e(?: (?:number|no\\.?))?", "licen[cs]e number", "permis de conduire", "führerschein(?:nr\\.?|nummer)?",
    "(?:permiso|carn[eé]|licencia) de conducir", "dni", "nie", "nif", "num[eé]ro de s[eé]curit[eé] sociale", "nir", "versicherungsnummer", "sozialversicherungsnummer", "número de la seguridad social",
    "historia cl[ií]nica", "num[eé]ro de dossier patient", "ausweis(?:nr\\.?|nummer)?",
]
_LINK = r"(?:\s?(?:is|est|es|lautet|ist|was|copied|number|nr\.?|n[°º]\.?|no\.?|#))?\s?[:#]?\s{0,2}"
ID_CUE = re.compile(rf"(?<![\w])(?:{'|'.join(CUES)}){_LINK}(?=\w)")
ID_BEHIND = re.compile(rf"{_NUMBER}{_E}")
#: A number followed by its meaning in brackets.
ID_NOTE = re.compile(r"\s\((?:travel document|driving|passport|licence|license|identity card|ssn|mrn)\)")
ID_BEFORE = re.compile(rf"{_B}{_NUMBER}$")

#: Words that give the number behind them another meaning.
REFERENCES = re.compile(
    r"(?:^|[^\w])(?:ticket|order|device|claim|batch|lot|accession|room|build|version|score|tag|file|rate|template|invoice|serial|model|part(?: no\.?)?|item|case|parcel|desk|slot|bed|page|bay|form|"
    r"commande|lote|charge|appareil|dispositivo|gerät|bestellung|pedido|rechnung|facture|factura)(?:\s?(?:no\.?|nr\.?|number|#|:))?\s{0,2}$",
    re.I,
)

#: What a text before such a number can end in (without blanks, ``#`` and ``:``), to look closer only then.
REFERENCE_ENDS = tuple("ticket order device claim batch lot accession room build version score tag file rate template invoice serial model part item case parcel desk slot bed page bay form commande lote charge appareil dispositivo gerät bestellung pedido rechnung facture factura no. nr. no nr number".split())

_ZIP = r"\d{5}(?:-\d{4})?(?!\d)"
_TYPES = "road|rd|street|st|avenue|ave|lane|ln|terrace|court|ct|boulevard|blvd|drive|way|place|close|crescent|square|parkway|pkwy"
_FLAT = r"(?:flat|apt|apartment|unit|suite|ste)\.?\s+(?:\d+[a-z]?|[a-z]\d*)"
#: French, Spanish and English streets, found around the words in STREET_WORDS.
STREETS = [
    re.compile(
        rf"(?<![\w.\-/:])\d{{1,4}}(?:\s?(?:bis|ter|quater))?,?\s+(?:rue|avenue|boulevard|impasse|chemin|place|allée|quai|route|cours|square)\s+(?:de\sla\s|de\sl['’]|du\s|des\s|de\s|d['’])?[^\W\d_][\w'’\-]+"
        rf"(?:,?\s(?:appt?|appartement|bât|esc)\.?\s\w{{1,4}})?(?:,?\s+(?P<zip>{_ZIP})\s+[^\W\d_][\w'’\-]+)?",
    ),
    re.compile(
        rf"(?<![\w\-])(?:calle|camino|avenida|avda\.?|plaza|paseo|ronda|travesía|carretera)\s+(?:de\slas\s|de\slos\s|de\sla\s|del\s|de\s)?[^\W\d_][\w'’\-]*(?:\s[^\W\d_][\w'’\-]*)?,?\s+\d{{1,4}}(?!\d)[a-z]?"
        rf"(?:,\s+(?:bajo|ático|entresuelo|\d{{1,2}}\.?\s?[ºª](?:\s?[a-z]\b)?))?(?:,?\s+(?P<zip>{_ZIP})\s+[^\W\d_][\w'’\-]+)?",
    ),
    re.compile(
        rf"(?<![\w.\-/:])(?:{_FLAT},?\s+)?\d{{1,5}}[a-z]?\s+[^\W\d_][\w'’]*(?:\s[^\W\d_][\w'’]*)?\s+(?:{_TYPES})\b(?:(?<=\bst)\.|(?<=\bave)\.(?=,)|(?<=\brd)\.(?=,)|(?<=\bblvd)\.(?=,))?"
        rf"(?:,?\s+{_FLAT})?(?P<tail>(?:,\s*|\s*[\r\n]+\s*)[^\W\d_][\w'’\-]+(?:\s[^\W\d_][\w'’\-]+)?(?:,?\s+(?:[a-z]{{2}}\s+)?(?P<zip>{_ZIP}))?)?",
    ),
]
#: A word of a proper name of any length; small words stand between capitalised ones.
_CAPS = r"[A-ZÀ-ÖØ-Þ][\w'’\-]*(?:\s(?:(?:of|on|the|de|la|las|los|le|les|du|des|del|y|et|and|und|an|der|am|im|upon|in|sur|von|zu)\s)*[A-ZÀ-ÖØ-Þ][\w'’\-]*)*"
#: Small words between the capitalised ones.
SMALL = frozenset("of on the de la las los le les du des del y et and und an der am im upon in sur von zu".split())
#: The same with names of any number of capitalised words; on the text as it is.
LONG_STREETS = [
    re.compile(
        rf"(?<![\w.\-/:])\d{{1,4}}(?:\s?(?:bis|ter|quater))?,?\s+(?i:rue|avenue|boulevard|impasse|chemin|place|allée|quai|route|cours|square)\s+(?:de\sla\s|de\sl['’]|du\s|des\s|de\s|d['’])?{_CAPS}"
        rf",?\s+{_ZIP}\s+[^\W\d_][\w'’\-]+"
    ),
    re.compile(
        rf"(?<![\w\-])(?i:calle|camino|avenida|avda\.?|plaza|paseo|ronda|travesía|carretera)\s+(?:de\slas\s|de\slos\s|de\sla\s|del\s|de\s)?{_CAPS},?\s+\d{{1,4}}(?!\d)[a-z]?"
        rf"(?i:,\s+(?:bajo|ático|entresuelo|\d{{1,2}}\.?\s?[ºª](?:\s?[a-z]\b)?))?(?:,?\s+{_ZIP}\s+[^\W\d_][\w'’\-]+)?"
    ),
    re.compile(rf"(?<![\w.\-/:])(?:(?i:{_FLAT}),?\s+)?\d{{1,5}}[A-Za-z]?\s+{_CAPS}\s+(?i:{_TYPES})\b"),
]
#: Town and postcode behind an English street, with names of any number of capitalised words.
LONG_TAIL = re.compile(rf"(?:,?\s+(?i:{_FLAT}))?(?:,\s*|\s*[\r\n]+\s*){_CAPS}(?:,\s+{_CAPS})*,?\s+(?:[A-Z]{{2}}\s+)?{_ZIP}")
#: A German street from the ending of its name on.
STREET_END = re.compile(
    rf"(?:straße|strasse|str\.|weg|allee|gasse|stieg|kamp|platz|ring|damm|ufer)\s+\d{{1,4}}(?!\d)\s?(?:[a-z]\b)?(?:\s?,\s?whg\.?\s\d+)?(?:,?\s+(?P<zip>{_ZIP})\s+[^\W\d_][\w'’\-]+)?"
)
STREET_WORDS = [
    "rue avenue boulevard impasse chemin place allée quai route cours square".split(),
    "calle camino avenida avda plaza paseo ronda travesía carretera".split(),
    _TYPES.split("|"),
]
#: First words of CUES, and of the notes behind a number.
CUE_WORDS = (
    "ssn social id identity national mrn med medical chart record patientennr patientennummer patienten passport passeport reisepass reisepassnr reisepassnummer pasaporte driver drivers driving "
    "licence license permis führerschein führerscheinnr permiso carné carne licencia dni nie nif numéro numero nir versicherungsnummer sozialversicherungsnummer número historia ausweis ausweisnr"
).split()
NOTE_WORDS = "travel driving passport licence license identity ssn mrn".split()
SPELLED_WORDS = _WORDS.split("|")
PLACEHOLDER = re.compile(r"\[[A-Z][A-Z_]*_?\d*\]")
#: Marks of the sentence's language, to tell a French title from an initial.
FRENCH = re.compile(r"\b(?:le|la|les|du|des|à|au|est|pour|avec|demande|votre|ma|mon|bonjour|svp|puis-je|rendez-vous)\b", re.I)
OTHER = re.compile(r"\b(?:the|and|at|of|my|for|with|is|und|am|um|bei|der|die|el|con|por|las|gracias)\b", re.I)
