"""Template residue, filler text and error or script-required pages.

One multi-pattern automaton reads each normalised text once. Its patterns are error messages and notices of pages,
filler phrases and words in four languages, and what announces a placeholder: openers of template syntaxes and the
words that stand for a value that was missing. Texts without a hit are done with there.

Where something was hit, coverage decides. Of a page's letters, or those of one of its lines, that are no function
words, names of hosts and files or identifiers, matched messages and the vocabulary of such pages must cover nearly
all; of a filler sentence, filler phrases must. A text that only speaks about such things has the same hits but words
of its own around them. A placeholder counts where the template put it: behind a greeting or a label, alone on its
line, or in a syntax that prose has no other use for; it is let go where the sentence quotes or explains it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the letters of a page, of a line that is such a message alone, and of a sentence of filler, that matched
#: fragments must cover.
PAGE_COVERAGE, LINE_COVERAGE, FILLER_COVERAGE = 0.75, 0.85, 0.85


def _all(*parts: str) -> list[str]:
    """Every combination of alternatives: _all("turn on|allow", "cookies|scripts") gives four phrases."""
    out = [""]
    for p in parts:
        out = [f"{a} {b}".strip() for a in out for b in p.split("|")]
    return out


#: Anchors of error pages and of script, cookie and browser-check notices.
PAGE_ANCHORS = [
    # English
    *_all("not found|bad gateway|gateway time-out|gateway timeout|service unavailable|internal server error|bad request|forbidden"),
    *_all("could not|failed to|was unable to|were unable to|unable to|cannot", "load|open|find|render|complete|display|show|reach"),
    *_all("connection|request|query|upstream|the connection|the request|the query|the upstream", "failed|timed out|was refused|was reset", "after"),
    *_all("this page|that address|the item|that page|this address|this item", "is gone|has moved|does not exist|is offline|is unavailable|was removed"),
    *_all("access denied|permission denied|you don't have permission|something went wrong|isn't working right now|sent no data"),
    *_all("link you followed has expired|session has expired|too many requests|temporarily unavailable|due to maintenance"),
    *_all("checking your browser|verify you are human|are you a robot|ddos protection"),
    *_all("check|checks|checking", "your", "browser|connection"),
    *_all("turn on|switch on|activate|allow|enable", "javascript|cookies|scripts|scripting"),
    *_all("requires|needs|cannot run without|works only with|does not work without", "javascript|cookies|scripts|a browser with scripting|cookies and scripts"),
    *_all("javascript is required|javascript is disabled|cookies are disabled|does not support scripting|database connection failed|too many clients already"),
    *_all("traceback (most recent call last)|keyerror|valueerror|typeerror|illegalstateexception|nullpointerexception|template cache closed|upstream timed out"),
    *_all("host unreachable|no healthy backend|quota exceeded|certificate expired|can't find what you're looking for"),
    # German
    *_all("aktivieren sie", "javascript|cookies|skripte"),
    *_all("benötigt|braucht|läuft nur mit|funktioniert nur mit", "javascript|cookies|skripte|skripten"),
    *_all("nicht gefunden|existiert nicht|nicht erreichbar|nicht verfügbar|konnte nicht geladen werden|verbindung wurde unterbrochen|zugriff verweigert|interner serverfehler"),
    # French
    *_all("activer|activez", "javascript|les cookies|les scripts"),
    *_all("ne fonctionne qu'avec|nécessite", "javascript|les cookies|les scripts|des scripts|des cookies"),
    *_all("est introuvable|page introuvable|est indisponible|ne répond pas|accès refusé|en maintenance|erreur interne"),
    # Spanish
    *_all("active|habilite|activar", "javascript|las cookies|los scripts"),
    *_all("necesita|requiere|solo funciona con|funciona solo con", "javascript|cookies|scripts"),
    *_all("no se encontró|no está disponible|no responde|acceso denegado|en mantenimiento|error interno"),
]
#: Function words, which count neither for nor against.
FUNCTION_WORDS = frozenset(
    "a an and are as at be been before but by do for from has have in is it its of on or our so that the their then there this to until was we were while with you your "
    "auf aus bitte das dem den der des die diese diesen dieser dieses ein eine einen einer er es für hat ihr ihre ihren im in ist mit nicht noch oder sie sind um und uns unsere von war wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il l' la le les leur n' ne notre nous ou par pas pour que qui s' se son sur un une vos votre vous "
    "al con de del el ella en es esta este estos la las lo los más no nuestra nuestro o para por que se su sus un una y".split()
)
#: The vocabulary of error pages and notices beside their messages.
PAGE_WORDS = frozenset(
    "sorry apologies whoops oops please page site server service shop store website address item link document basket cart checkout catalogue preview request requested message menu search home login "
    "error errors code status reason detail details id reference ref ray http https try trying again later go back loading wait hold moment gateway browser browsers settings reload refresh continue "
    "using use app run view see offer open opening opened load find render need needs turn turned switch switched enable enabled allow allowed javascript cookies cookie scripts script scripting sign "
    "slow down retry network side resource unavailable seconds second minutes attempts attempt takes ms file line shown works only show display complete reach followed visited right now one later. "
    "seite seiten server dienst fehler störung artikel angeforderte adresse anzuzeigen anzeigen derzeit versuchen später einmal shop skripte browser verbindung warenkorb fehlercode "
    "page boutique service erreur demandée demandé veuillez afficher réessayer plus tard serveur navigateur panier code "
    "página páginas tienda servicio error navegador ver solicitada solicitado inténtelo intente nuevo tarde servidor favor código".split()
)
#: Anchors and parts of filler text.
FILLER_ANCHORS = [
    *_all("headline|body|caption|teaser|title|intro|subtitle", "copy|text", "goes here|tbd|pending|missing|follows|to come|to follow"),
    *_all("headline|body|caption|teaser|title|intro|text|copy|product description", "goes here|to follow|to come|tbd"),
    *_all("insert|add|put|type|write|enter", "some|the|your|a short|a", "headline|teaser|intro|caption|closing line|product text|description of your product|text|title", "here|before sending|in this box|of your product"),
    *_all("insert|add|put|type|write|enter", "some|the|your|a short|a", "headline|teaser|intro|caption|closing line|product text|description of your product"),
    *_all("insert|add|put|type|write|enter", "teaser text|product text|headline|body copy|caption"),
    *_all("your text here|your title here|your headline here|edit this paragraph to tell your story|placeholder copy|do not publish|sample text|replace before sending|dummy text"),
    *_all("todo write copy for this block|write copy for this block|tbd tbd tbd|tbd tbd|blah blah blah|blah blah|test test test|lorem ipsum"),
    *_all("blindtext|fülltext|platzhaltertext|beispieltext"),
    *_all("fließtext|fliesstext|titel|teaser|überschrift|text|bildunterschrift", "hier|bitte", "einfügen|eintragen|ergänzen"),
    *_all("texte de remplissage|texte d'exemple|texto de ejemplo|texto de relleno|faux texte"),
    *_all("texte|texto|titre|título|titulo|titular|légende", "ici|aquí|à venir|pendiente|por definir"),
]
FILLER_WORDS = frozenset("before sending here todo tbd blah test box product description copy text write replace placeholder sample short newsletter steht modifier sustituir insert add put type enter".split())
#: The words of the usual mock Latin, and of hands run over a keyboard.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim "
    "veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit "
    "esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
MASH = frozenset("asdf qwer hjkl sdfg dfgh fghj ghjk jkl uiop lkjh zxcv xcvb qwerty qwertz asdfgh qqqq xxxx zzzz aaaa test".split())
#: What opens a placeholder in a template syntax, and words that stand for a missing value.
OPENERS = ("{", "[", "<", "%", "*|", "${", "#{", "@@", "##", "__", "«")
VOIDS = ("null", "undefined", "none", "nan", "nil", "invalid date", "%s", "%d", "[object object]")
#: Greetings, labels and fixed phrases behind which a template puts a value.
FRAMES = (
    "dear", "hello", "hi", "hey", "hallo", "guten tag", "liebe/r", "lieber", "liebe", "bonjour", "cher", "chère", "estimado", "estimada", "hola", "thanks,", "thank you,",
    "total due:", "amount due:", "your total is", "your order", "betrag:", "montant:", "importe:", "ihre bestellung", "votre commande", "su pedido", "tu pedido", "items:", "delivered on", "for order",
)
#: Words of a sentence that speaks about placeholders, verbs that have one as their object, and of code.
META_WORDS = frozenset("syntax placeholder placeholders variable variables tag tags token tokens field fields column columns template templates platzhalter variablen feld felder syntaxe champ champs balise variables marcador marcadores etiqueta campo campos sintaxis means heißt bedeutet signifie significa".split())
META_VERBS = frozenset("put write use type insert enter keep leave add replace copy setze setzen schreibe schreiben verwende verwenden mettez écrivez utilisez ponga pon escriba escribe use usa".split())
CODE_WORDS = re.compile(r"\b(?:SELECT|FROM|WHERE|INSERT|UPDATE|JOIN|SET|echo|export|printf?)\b")
_COMPARED = re.compile(r"[=<>]=?\s*$")
_INK = re.compile(r"\w")

_ZERO_WIDTH = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
_TAG = re.compile(r"</?(?:div|p|html|head|title|body|center|h\d|noscript|span|br|b|i|hr|a|td|tr|table|ul|ol|li|strong|em|section|main|header|footer)\b[^<>]*>", re.I)
#: Names of hosts and files, identifiers and places in a stack: no words of a text.
_NAMES = re.compile(r'file "[^"\n]*", line \d+, in \S+|[\w-]+(?:[./:\\][\w-]+)+|\w*[\d_]\w*')
WORD = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
_SENTENCE_END = re.compile(r"\n|(?<=[.!?…])[ \n]")
_NAME = r"[^\W\d_][\w. -]*|\d{1,3}"
SYNTAX = re.compile(
    rf"\{{\{{\{{?[^{{}}\n]+\}}?\}}\}}|\{{%[^\n%]+%\}}|\{{[!#$]?(?:{_NAME})\}}|\*\|(?:{_NAME})\|\*|<%[=-]?[^\n%]+%>|%%(?:{_NAME})%%|%[A-Za-z][A-Za-z_. ]+%"
    rf"|\[\[(?:{_NAME})\]\]|[$#]\{{[^{{}}\n]+\}}|@@(?:{_NAME})@@|##(?:{_NAME})##|__(?:[A-Za-z][A-Za-z. ]*(?:_[A-Za-z. ]+)*)__|«(?:{_NAME})»|<<(?:{_NAME})>>"
    r"|\[[A-Z][A-Z_. ]{2,}\]|<(?:INSERT|YOUR|ENTER)[A-Z_. ]{2,}>|<[A-Z]{2,}_[A-Z_]{2,}>|\[%[^\n%]+%\]"
)
#: Syntaxes that prose has no other use for.
TEMPLATE_ONLY = ("{{", "*|", "<%", "{%", "%%", "[[", "@@", "«", "<INSERT", "<<")
_FRAMED = re.compile(r"(?<![\w'\"`„“«])(?:" + "|".join(re.escape(f).replace(":", " ?:") for f in sorted(FRAMES, key=len, reverse=True)) + r")\s+$")
_LONGEST_FRAME = max(map(len, FRAMES)) + 4
_VOID_AFTER = re.compile(r"\)?\s*(?:[,!:.;]|$|\n)|\)?\s+(?:is on|to|ist|est|va|welcome)\b|\)?\s+(?![a-zß-öø-ÿ])")
_QUOTES = "'\"`„“”«»’‘"


def normalised(text: str) -> str:
    """Compatibility forms, no zero-width characters or HTML tags, straight quotes, one blank for a run of them. The
    case stays, and the lower case has the same length."""
    t = text
    if not t.isascii():
        t = _ZERO_WIDTH.sub("", unicodedata.normalize("NFKC", t)).replace("’", "'").replace("‘", "'").replace("İ", "I")
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    if "<" in t:
        t = _TAG.sub("\n", t)
    return "\n".join([" ".join(line.split()) for line in t.split("\n")])


@lru_cache(maxsize=1)
def automaton():
    """All patterns; the payload is (length, kind)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    groups = [("opener", OPENERS), ("void", VOIDS), ("latin", [w for w in LATIN if len(w) > 3]), ("mash", [*MASH, *(c * 4 for c in "abcdefghijklmnopqrstuvwxyz"), "xxx"]), ("filler", FILLER_ANCHORS), ("page", PAGE_ANCHORS)]
    for kind, patterns in groups:
        for p in patterns:
            a.add_word(p.lower(), (len(p), kind))
    a.make_automaton()
    return a


def hits(low: str) -> dict[str, list[tuple[int, int]]]:
    """kind -> [(start, end)] of the patterns in a text in lower case, those of words at word borders only."""
    flat = low.replace("\n", " ")
    n, out = len(flat), {}
    for last, (length, kind) in automaton().iter(flat):
        a, b = last + 1 - length, last + 1
        if kind == "opener" or not ((a and flat[a].isalnum() and flat[a - 1].isalnum()) or (b < n and flat[last].isalnum() and flat[b].isalnum())):
            out.setdefault(kind, []).append((a, b))
    return out


def covered(text: str, start: int, end: int, spans: list[tuple[int, int]], vocabulary: frozenset[str]) -> float:
    """Share of the letters of text[start:end] that lie in a span or a word of the vocabulary; words inside names and
    function words count neither way. 0 without letters of other words."""
    skipped = [m.span() for m in _NAMES.finditer(text, start, end)]
    inside = total = 0
    k = j = 0
    spans = sorted(s for s in spans if s[1] > start and s[0] < end)
    reach = 0
    for m in WORD.finditer(text, start, end):
        a, b = m.span()
        while j < len(spans) and spans[j][0] <= a:
            reach = max(reach, spans[j][1])
            j += 1
        if b <= reach:
            inside += b - a
            total += b - a
            continue
        while k < len(skipped) and skipped[k][1] <= a:
            k += 1
        if (k < len(skipped) and skipped[k][0] <= a) or m.group() in FUNCTION_WORDS:
            continue
        total += b - a
        if m.group() in vocabulary:
            inside += b - a
    return inside / total if total else 0.0


def is_page(low: str, spans: list[tuple[int, int]]) -> bool:
    """The text as a whole, or one whole line of it, is a message of this kind: a page that broke off after some
    content has it in the place of the rest. A sentence that mentions or quotes one has other words around it."""
    if covered(low, 0, len(low), spans, PAGE_WORDS) >= PAGE_COVERAGE:
        return True
    done = -1
    for a, _ in spans:
        if a <= done:
            continue
        start, done = low.rfind("\n", 0, a) + 1, (low.find("\n", a) + len(low) + 1) % (len(low) + 1)
        if covered(low, start, done, spans, PAGE_WORDS) >= LINE_COVERAGE:
            return True
    return False


def is_latin(words: list[str]) -> bool:
    """Four words or more of mock Latin in a row, three of them different."""
    run: list[str] = []
    for w in [*words, ""]:
        if w in LATIN:
            run.append(w)
        else:
            if len(run) >= 4 and len(set(run)) >= 3 and sum(len(x) > 3 for x in run) >= 3:
                return True
            run = []
    return False


def has_filler(low: str, found: dict[str, list[tuple[int, int]]]) -> bool:
    """A sentence with a hit that filler phrases cover, or that is mock Latin or a mashed keyboard."""
    borders = [0, *[m.end() for m in _SENTENCE_END.finditer(low)], len(low)]
    at, spans, done = 0, found.get("filler", []), -1
    for a, _ in sorted(x for kind in ("filler", "latin", "mash") for x in found.get(kind, [])):
        if a < done:
            continue
        while borders[at + 1] <= a:
            at += 1
        start, done = borders[at], borders[at + 1]
        words = WORD.findall(low, start, done)
        if is_latin(words):
            return True
        if len(words) >= 3 and all(w in MASH or re.fullmatch(r"x{3,}|(\w)\1{3,}", w) for w in words):
            return True
        if any(start <= x < done for x, _ in spans) and covered(low, start, done, spans, FILLER_WORDS) >= FILLER_COVERAGE:
            return True
    return False


def _sentence(text: str, a: int, b: int) -> tuple[int, int]:
    """Where the sentence around text[a:b] begins and ends."""
    start = max(text.rfind(x, 0, a) for x in ("\n", ". ", "! ", "? "))
    ends = [e for e in (text.find(x, b) for x in ("\n", ". ", "! ", "? ")) if e >= 0]
    return start + 1, min(ends, default=len(text))


def _speaks_of_slots(sentence: str) -> bool:
    """Words about placeholders, or of code, beside the slots themselves."""
    bare = SYNTAX.sub(" ", sentence)
    return bool(META_WORDS.intersection(WORD.findall(bare.lower()))) or bool(CODE_WORDS.search(bare))


def is_quoted_or_asked_for(text: str, a: int, b: int) -> bool:
    """text[a:b] stands in quotes, is the object of an instruction, or is what something is compared with in code."""
    before = text[max(0, a - 40) : a]
    if before[-1:] in tuple(_QUOTES) and text[b : b + 1] in tuple(_QUOTES):
        return True
    words = WORD.findall(before.lower())
    return bool(words and words[-1] in META_VERBS and before[-1:] == " ") or bool(_COMPARED.search(before))


def has_placeholder(text: str, low: str, found: dict[str, list[tuple[int, int]]]) -> bool:
    """An unfilled placeholder, or a value that a template failed to fill, that is neither quoted nor explained. A slot
    that no frame announces counts if its syntax has no other use in prose, or if it fills its line."""
    for a, b in found.get("void", []):
        a -= low[a - 1 : a] == "("
        if _FRAMED.search(low[max(0, a - _LONGEST_FRAME) : a]) and _VOID_AFTER.match(text, b):
            return True
    done, sentence, explained, line, alone = -1, (0, -1), False, (0, -1), False
    for a, _ in found.get("opener", []):
        m = SYNTAX.match(text, a) if a >= done else None
        if not m:
            continue
        done = m.end()
        if _FRAMED.search(low[max(0, a - _LONGEST_FRAME) : a]):
            return True
        if not m.group().startswith(TEMPLATE_ONLY):
            if not line[0] <= a < line[1]:
                end = text.find("\n", done)
                line = (text.rfind("\n", 0, a) + 1, end if end >= 0 else len(text))
                alone = not _INK.search(SYNTAX.sub(" ", text[line[0] : line[1]]))
            if not alone:
                continue
        if is_quoted_or_asked_for(text, a, done):
            continue
        if not sentence[0] <= a < sentence[1]:
            sentence = _sentence(text, a, done)
            explained = _speaks_of_slots(text[sentence[0] : sentence[1]])
        if not explained:
            return True
    return False


def residue_kind(text: str | None) -> str | None:
    """placeholder, filler, page, or None for a text that is none of them (also null, empty and blank ones)."""
    if not text or text.isspace():
        return None
    t = normalised(text)
    low = t.lower()
    found = hits(low)
    if ("void" in found or "opener" in found) and has_placeholder(t, low, found):
        return "placeholder"
    if ("filler" in found or "latin" in found or "mash" in found) and has_filler(low, found):
        return "filler"
    return "page" if "page" in found and is_page(low, found["page"]) else None


def residue(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, kind) of the documents that are template residue; see residue_kind().

    Texts are read whole and each by itself, without a shuffle; repeated rows give repeated rows, a null id is
    returned as it is, other columns are not read, and an empty table gives an empty one."""
    id_type = docs.schema[doc].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = pa.array([residue_kind(t) for t in b.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc"), kinds], names=["doc", "kind"])

    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(find, f"doc {id_type}, kind string")
    return rows.where("kind is not null").select(F.col("doc").alias(doc), "kind")
