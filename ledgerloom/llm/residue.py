"""Template residue, filler, error pages and demands to enable scripts.

A multi-pattern automaton (Aho-Corasick) passes once over each text and names
the sentences that hold a literal some grammar needs; only these sentences are
read further, so the cost is one pass for a text without any.

* Placeholders have one grammar per delimiter.  What the delimiter alone decides
  (``{{x}}``, ``${x}``, ``<% %>``, ``%X%``) needs no list of field names; square
  and angle brackets and single braces, which prose and markup use too, are
  read by the form of what they hold.
* Filler, error messages and script demands are told by the form of their
  sentence: a status with its reason, a page or document that could not be
  shown, a script word with a demand, a need or a lack.
* Density: pseudo-Latin and keyboard filler by the share of such words, and runs
  of ten words without one function word of the corpus's languages.

Context discounts what only writes about such things: code (fenced, inline,
indented, in code elements; of any length) is cut out; a match inside quotes
within a longer sentence is a mention; so is a placeholder or Latin word in a
sentence that speaks of placeholders, variables, syntax, manuals and the like
outside of the match; and in a text most of whose matching sentences do so (a
tutorial), the others are discounted as well.

Defined results: null, empty and blank texts hold no residue; the result has
one row per document row found, with the families that were met.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tokens import spread

# Words that name or ask for a field in lower-case brackets, and words brackets hold in edited prose.
FIELD = (
    "name namen firma sitz ort datum betrag anzahl unterschrift umsatz ergebnis waehrung währung adresse anschrift straße strasse plz kunde titel vorname nachname telefon company client date amount place signature city address "
    "recipient todo tbd placeholder platzhalter nom société montant lieu ville xx"
)
ASKED = "bitte insert enter your ihr ihre hier here eingeben einfügen ergänzen eintragen insérer compléter fill add tt.mm.jjjj dd.mm.yyyy jj.mm.aaaa hrb hrb_nr"
EDITORIAL = "sic anm anmerkung hervorhebung hervorhebungen note quelle source edit update bild foto video abb abbildung tabelle table figure fig siehe vgl red kursiv original auszug citation ref"
ELEMENTS = (
    "a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption center cite code col colgroup data dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 "
    "head header hr html i iframe img input ins kbd label legend li link main map mark meta meter nav noscript object ol optgroup option output p param picture pre progress q s samp script section select small source span strike strong style sub "
    "summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr xml path g"
)
# Words a sentence uses when it writes about placeholders and filler.
MENTIONED = (
    r"placeholders?|platzhaltern?|platzhalters|variablen?|variables?|syntax|template engines?|jinja2?|handlebars|mustache|freemarker|thymeleaf|twig|ausdruck|ausdrücke|expressions?|tutorials?|anleitung(?:en)?|handbuch|handbuchs|manual|documentation|dokumentation|"
    r"how to|escaped?|renders?|rendered|expands? to|(?:is|are|be|was) (?:then )?(?:replaced|substituted)|(?:wird|werden) (?:dann |dabei )?(?:durch|mit) .{1,60} ersetzt|(?:stands?|steht|stehen) (?:for|für)|e\.g\.|z\. ?b\.|zum beispiel|for example|par exemple|notation|schreibweise|"
    r"endmarke|markers?|regex|formel|formula|balises?|derives? from|derived from|stammt|originates?|cicero|latin|lateinisch\p{L}*|typesett\p{L}*|dummy text of|named|called|genannt|heißt|bezeichnet|denotes?|champs?"
)
LATIN = (
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisici elit sed do eiusmod eiusmodi tempor incididunt incidunt ut labore et dolore magna aliqua aliquam enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea "
    "commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum nonumy eirmod invidunt erat voluptua"
)
KEYS = "test asdf jklö qwertz qwerty abc foo bar bla xyz baz blah"
# Function words of the corpus's languages; ten plain words in a row without one are no language but filler.
FUNCTION = frozenset(
    "der die das des dem den ein eine eines einer einem einen und oder nicht kein keine mit von vom zu zum zur auf aus in im ins an am bei für um ist sind war waren wird werden wurde wurden hat haben sich als nach vor über unter durch bis ab so wie es er sie wir "
    "auch nur noch the a an of and or to in on at by for with from as is are was were be been has have had it its this that not no but than le la les l un une de du d et ou en dans sur au aux par pour avec est sont ont ne pas qui que il elle se son sa ses ce cette plus".split()
)
RUN = 10


def _words(text: str) -> str:
    return "|".join(regex.escape(w) for w in text.split())


B = "[  ]"
_NAME = r"[\p{L}_#^/&>][\p{L}\p{N}_.\-]*+"
PLACEHOLDERS = {
    "{{": r"\{\{[{&#/^>~]?\s*+[\p{L}_@$][^{}\n]{0,80}+\}\}",
    "${": r"[$#]\{\s*+[\p{L}_][^{}\n]{0,60}+\}",
    "<%": r"<%[=\-@!]?+\s*+[\p{L}_][^%\n]{0,80}+%>",
    "{%": r"\{%-?\s*+\p{L}[^%\n]{0,80}+%\}",
    "{": r"(?<![\p{L}\p{N}{$#%@\\\]}])\{[A-Za-z]\w*+(?:[._]\w++)*+(?<=\w{3})\}(?!\}|[ ]*+[/=+*\-:])",
    "[": (
        rf"(?<![\p{{L}}\p{{N}}\]])\[(?:(?iu:{_words(FIELD)}|{_words(ASKED)})(?![\p{{L}}:])[^\[\]\n0-9:]{{0,40}}+|[\p{{Lu}}][\p{{Lu}} ,._]{{3,40}}+|●|•|_{{3,}}+|\.\.\.(?=\]{B}*+(?:T?EUR|€|%|\())"
        rf"|(?!(?iu:{_words(EDITORIAL)})(?!\p{{L}}))\p{{Lu}}\p{{Ll}}{{2,20}}+(?: \p{{L}}{{2,20}}+){{0,2}}+)\](?![\[(:])"
    ),
    "<": rf"(?<![\p{{L}}\p{{N}}<])<(?!(?:{_words(ELEMENTS)})[ />])(?:(?iu:{_words(FIELD)}|{_words(ASKED)})(?![\p{{L}}:=/])[^<>&=/\n0-9]{{0,40}}+|\p{{Lu}}\p{{Ll}}{{2,20}}+(?:[ ,/_]{{1,2}}\p{{L}}{{2,20}}+){{0,3}}+)>",
    "&lt;": rf"&lt;(?iu:{_words(FIELD)}|{_words(ASKED)})(?![\p{{L}}:=/])[^<>&=/\n0-9]{{0,40}}+&gt;",
    "«": rf"«(?:(?iu:{_words(FIELD)}|segment|geschaeftsfuehrer|geschaeftsjahr|gesellschaft)(?!\p{{L}})[A-Za-z_.]{{0,30}}+|[A-Za-z]++[_.][A-Za-z_.]++)»",
    "%": r"%[A-Z][A-Z0-9_.]{2,40}+%",
    "__": r"(?<![\p{L}\p{N}_])__[A-Z][A-Z0-9_.]*?[A-Z0-9]__(?![\p{L}_])",
    "##": r"##[A-Z][A-Z0-9_.]{1,40}+##",
    "@@": r"@@[A-Za-z][A-Za-z0-9_.]{1,40}+@@",
    "_____": rf"_{{5,}}+{B}?\([^()\n]{{2,60}}\)|^[\p{{L}} ]{{2,30}}:{B}*_{{5,}}+",
    "xx.xx.": r"(?<![\p{L}\p{N}])XX\.XX\.(?:20XX|19XX|XXXX|\d{4})(?![\p{L}\p{N}])",
    "(": r"(?iu:\((?:bitte ergänzen|bitte eintragen|please complete|to be completed|à compléter)\))",
}
# Sentences that say of themselves that they are no content; ^ and $ are a sentence's ends.
TAIL = rf"{B}*+[.!…]*+$"
FILLER = {
    ("text", "fläche", "factice"): (
        r"(?iu)(?:dies|das|hier) ist (?:ein |nur )?(?:ein )?(?:blind|füll|muster|beispiel|platzhalter)text|\bzeilen fülltext|^(?:er|sie|es|dieser text) füllt nur\b|(?:blind|muster|platzhalter)text (?:bitte )?(?:überschreiben|ersetzen|austauschen)|"
        r"(?:bitte )?(?:diesen?|den) (?:blind|muster|platzhalter)text (?:überschreiben|ersetzen|austauschen)|this is (?:a |some |just )?(?:dummy|placeholder|sample|filler) text|ceci est un texte (?:d'exemple|factice)"
    ),
    ("folgt", "à venir", "soon", "text", "tbd", "tba", "todo", "to be", "noch kein"): (
        rf"(?iu)^(?:text folgt|inhalt folgt(?: in kürze)?|texte à venir|contenu à venir|(?:content )?coming soon|hier text (?:eingeben|einfügen)|(?:insert|enter|add) (?:your )?text here|tbd|tba|todo|to be (?:defined|added|determined|completed))(?:{TAIL}|{B}+(?:stand|status|draft|entwurf)\b[^.]{{0,30}}$)|an dieser stelle steht noch kein inhalt"
    ),
    ("muster", "beispiel", "sample"): r"(?iu)^(\p{L}{3,12}) \1 \1(?=[ .,]|$)|musterweg \d++, \d++ musterort|muster(?:straße|str\.) \d++\p{L}?, \d++ musterstadt|^(?:sample paragraph|beispieltext)[  ]\d++$",
}
THING = "(?:dokument|trefferliste|liste|übersicht|bericht|registerauszug|datei|seite|webseite|website|veröffentlichung|bekanntmachung|abschluss|jahresabschluss|eintrag|inhalt|anfrage|suche)"
REASON = "(?:not found|forbidden|unauthorized|bad request|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|internal server error|request time-?out|too many requests|method not allowed|gone|not acceptable)"
ERRORS = {
    ("nicht gefunden", "not found", "introuvable", "demandée", "existiert nicht", "gelöscht", "verschoben", "ist nicht", "does not exist", "could not", "cannot", "treffer", "no results", "aucun résultat"): (
        rf"(?iu)(?:^|[–:-] ?)seite nicht gefunden|page not found|^(?:\W|\d)*page introuvable|la page demandée|(?:angeforderte|gesuchte|aufgerufene) {THING} (?:existiert nicht|wurde gelöscht|wurde nicht gefunden|wurde verschoben|ist nicht)|the (?:requested )?page (?:you|does not exist|could not|cannot)|^(?:keine? treffer|no results|aucun résultat){TAIL}"
    ),
    ("konnte", "kann", "could not", "couldn't", "unable to", "cannot", "failed to", "impossible", "nicht möglich"): (
        rf"(?iu)\b(?:der|die|das) {THING}(?: \S{{1,20}})? (?:konnte|kann)(?: \S{{1,14}}){{0,3}}? nicht (?:gefunden|abgerufen|geladen|geöffnet|angezeigt|dargestellt) werden|\b(?:could not|couldn't|unable to|cannot|failed to) (?:retrieve|load|open|display|find|fetch) (?:the|this|your) (?:requested )?"
        rf"(?:report|document|page|file|filing|record|results?|list|content|notice|announcement|statement|site|register|excerpt)|impossible d'afficher|(?:die )?anzeige (?:ist )?(?:daher |leider )?nicht möglich"
    ),
    ("fehler", "error", "erreur", "wrong", "http", "status", "gateway", "unavailable", "unable", "requests", "slow down", "verfügbar", "erreichbar", "reset by peer", "verbindung", *(f"{n} " for n in (400, 401, 403, 404, 405, 408, 410, 429, 500, 502, 503, 504))): (
        rf"(?iu)\b(?:interner|unbekannter|unerwarteter|schwerer) (?:server|system|anwendungs|datenbank)?fehler(?: aufgetreten| im modul \p{{L}}+)?{B}*+(?:[.!]|$)|^fehler beim (?:laden|öffnen|abrufen|anzeigen)|keine verbindung zu[rm] (?:datenbank|server)|something went wrong|une erreur (?:est survenue|s'est produite)|"
        rf"an (?:unexpected |internal |unknown )?error (?:has )?occurred|the server was unable|slow down and try again|(?:service|dienst|seite) vorübergehend nicht (?:verfügbar|erreichbar)|connection reset by peer|^(?:http(?:/\d\.\d)?{B}?|error{B}|status{B}|fehler{B}|\W)*+[45]\d\d{B}*+[–:-]?{B}*+{REASON}\b|^{REASON}{TAIL}|"
        rf"^(?:http )?(?:error|fehler|status)(?: code)?{B}[45]\d\d{B}?[:–-]|^(?:fehlernummer \S++|http status \d++|error \d{{3}}|http \d{{3}}){TAIL}|^erreur \(\d++\)|^(?:internal server error|bad gateway|gateway time-?out|service unavailable|too many requests)\b"
    ),
    ("verweigert", "refusé", "denied", "forbidden", "rechte", "permission"): rf"(?iu)^(?:zugriff verweigert|accès refusé(?: \(\d++\))?|access denied|forbidden|permission denied){TAIL}|sie besitzen nicht die nötigen rechte|you do(?: not|n't) have permission to (?:access|view)",
    ("sitzung", "melden sie sich", "session", "log in", "sign in", "robot", "human"): r"(?iu)(?:ihre|deine) sitzung ist abgelaufen|bitte melden sie sich (?:erneut|wieder) an|your session has (?:expired|timed out)|^please (?:log|sign) in again|votre session a expiré|dass sie kein roboter sind|that you are (?:not a robot|human)|que vous n'êtes pas un robot",
    ("später", "plus tard", "later"): rf"(?iu)^(?:bitte versuchen sie es später (?:erneut|noch einmal|wieder)|veuillez réessayer plus tard|(?:please )?try again later){TAIL}",
    ("traceback", "at ", "file ", "exception", "error", "warning:", "segmentation"): (
        r"Traceback \(most recent call last\)|^at [\w.$<>]++\([\w.$ ]++(?::\d++)?\)|^File \"[^\"]++\", line \d++|\b(?:java|javax|org|com|net|sun)\.[\w.]{1,120}?(?:Exception|Error)\b|^(?:Key|Value|Type|Index|Name|Attribute|Runtime|Zero|Import|OS|IO)\w*Error: |Warning: \w++\([^()]*+\): failed|^(?:PHP )?Fatal error: |Uncaught (?:TypeError|ReferenceError|exception)|^Segmentation fault"
    ),
}
S = r"\b(?:java ?scripts?|js|skripte?n?|scripts?|scripting|aktiven? inhalte?n?|client-side scripts?)\b(?![ -](?:knowledge|skills?|kenntniss\p{L}*|developers?|entwickler\p{L}*|experience|erfahrung\p{L}*|widgets?|frameworks?|bibliothek\p{L}*|librar\p{L}*|engines?|tutorials?|code|programmier\p{L}*))"
PAGE = r"(?:seiten?|webseite|website|webanwendung|anwendung|portal|shop|dokument\p{L}*|inhalte?|darstellung|anzeige|nutzung|funktion\p{L}*|page|site|app|application|service|content|document|browser|cette|ce|contenu|this|our|you|your|ihr|ihrem|sie)"
DEMANDS = (
    # asked of the reader
    rf"(?iu)\b(?:bitte|please|veuillez|devez|merci d[e']|you (?:must|need to|have to|should)|sie müssen|müssen sie|um fortzufahren|to (?:continue|view|use|see|run)|falls nichts erscheint)\b.*?{S}|^(?:enable|turn on|switch on|activate|allow|unblock|aktivieren|erlauben|schalten|activez)\b.*?{S}|(?:aktivieren|erlauben|zulassen|gestatten|lassen|schalten) sie (?:bitte )?{S}|{S}.*?\b(?:aktivieren|erlauben|zulassen|einschalten|enable)\b[.!]*+$",
    # needed by the page
    rf"(?iu)\b{PAGE}\b.*?\b(?:requires?|needs?|relies on|rely on|benötigt|braucht|verlangt|erfordert|setzt|nécessite|works? (?:only )?with|funktioniert (?:nur )?mit|läuft (?:nur )?mit|fonctionne (?:seulement |qu')?avec)\b.{{0,30}}?{S}|{S}.{{0,12}}?\b(?:ist|sind|is|are|muss|müssen|must|est) ?(?:be )?(?:erforderlich|benötigt|notwendig|nötig|required|needed|aktiviert|zugelassen|eingeschaltet|requis|vorausgesetzt)|\bist {S} (?:erforderlich|nötig|notwendig)|\brequires? scripts? to be",
    # lacking
    rf"(?iu)\b(?:ohne|without|sans) (?:aktivierte[sn]? |les |enabled )?{S}.{{0,3}}? ?(?:kann|können|ist|lässt|wird|this|the|cannot|can't|some|ne)|ne peut (?:pas )?être affichée?s? sans (?:les )?{S}|blockiert {S}|{S} (?:ist |sind |is |are |seems |appears |currently |has been |to be )*+(?:deaktiviert|blockiert|gesperrt|ausgeschaltet|disabled|blocked|turned off|switched off|désactivé)\b",
)
FENCE = regex.compile(r"^[ \t]*+(`{3,}+|~{3,}+)")
INLINE = regex.compile(r"(`++)[^`\n]++\1")
CODE_ELEMENT = regex.compile(r"(?is)<(code|pre|samp|kbd|script|style)\b[^>]*+>.*?</\1>")
INDENTED = regex.compile(r"(?: {4}|\t)[ \t]*+\S")
END = regex.compile(r"(?<=[.!?…][»”“\"')\]]?)[\s  ]++|\n++")
QUOTES = regex.compile(r"„[^“”\n]{1,120}+[“”\"]|\"[^\"\n]{1,120}+\"|«[  ]?[^»\n]{1,120}+»|“[^”\n]{1,120}+”|‘[^’\n]{1,120}+’|(?<!\p{L})'[^'\n]{1,120}+'")
MENTION = regex.compile(rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{MENTIONED})(?![\p{{L}}\p{{N}}])")
HOW_TO = regex.compile(r"(?iu)\b(?:how to|how do i|wie (?:man|sie) |anleitung|tutorial|comment (?:activer|faire)|erklärt|explains?|guide to)\b")
LINES = regex.compile(r"(?m)(?:^[  ]*+(?:Sample paragraph|Beispieltext|Absatz|Muster|Titel|Überschrift|Headline|Heading|Paragraph|Paragraphe|Titre)[  ]\d++[  ]*+$(?:\r?\n)?){2,}")
XES = regex.compile(r"(?<!\p{L})[Xx]x++(?:[ \n,.]++[Xx]x++){4,}")
WORD = regex.compile(r"[\p{L}\p{N}]++")
PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz")


@functools.cache
def _machine() -> tuple[ahocorasick.Automaton, dict]:
    """The automaton over the needed literals, each with the grammars it opens."""
    opens: dict[str, list[tuple[str, regex.Pattern]]] = {}

    def add(literals: tuple[str, ...] | list[str], family: str, pattern: str) -> None:
        compiled = regex.compile(pattern)
        for literal in literals:
            opens.setdefault(literal, []).append((family, compiled))

    for literal, pattern in PLACEHOLDERS.items():
        add([literal] if literal != "${" else ["${", "#{"], "placeholder", pattern)
    for literals, pattern in FILLER.items():
        add(literals, "filler", pattern)
    for literals, pattern in ERRORS.items():
        add(literals, "error", pattern)
    for pattern in DEMANDS:
        add(("script", "skript", "js", "aktive inhalte", "aktiven inhalte", "aktive"), "script", pattern)
    machine = ahocorasick.Automaton()
    for literal, grammars in opens.items():
        machine.add_word(literal, (literal, grammars))
    for literal in (" xx", "xxx", "lorem", "dolor sit", "consectetu", "\nmuster", "\nabsatz", "\ntitel", "\ntitre", "\nparagraph", "\nhead", "\nüberschrift", *(f" {k}" for k in KEYS.split())):
        machine.add_word(literal, (literal, opens.get(literal, [])))
    machine.make_automaton()
    return machine, opens


def without_code(text: str) -> str:
    """The text without fenced blocks, code elements and inline code; a fence that is never closed ends with the text."""
    if "```" in text or "~~~" in text:
        kept, fence = [], ""
        for line in text.split("\n"):
            m = FENCE.match(line)
            if fence:
                if m and m[1].startswith(fence) and not line.strip("`~ \t\r"):
                    fence = ""
                kept.append("")
            elif m and m[1] not in line[m.end() :]:
                fence = m[1]
                kept.append("")
            else:
                kept.append(line)
        text = "\n".join(kept)
    if "</" in text:
        text = CODE_ELEMENT.sub(" ", text)
    return INLINE.sub(" ", text) if "`" in text else text


def _indented(text: str) -> set[int]:
    """Offsets at which lines of indented code begin: after a blank line or a colon, in a run of such lines."""
    out, at, opened = set(), 0, True
    for line in text.split("\n"):
        if INDENTED.match(line):
            if opened:
                out.add(at)
        else:
            opened = not line.strip() or line.rstrip().endswith(":")
        at += len(line) + 1
    return out


def _pseudo_language(text: str) -> bool:
    """Ten plain words in a row without a function word; a list (a comma after most words) is none."""
    run = commas = 0
    start = True
    for word in text.split():
        bare = word.rstrip(".,")
        low = bare.lower() if start else bare
        if len(bare) > 1 and low not in FUNCTION and PLAIN.issuperset(low):
            run += 1
            commas += word.endswith(",")
            if run >= RUN and 2 * commas < run:
                return True
        else:
            run = commas = 0
        start = word[-1] in ".!?:" or run == 0 and start
    return False


def _keyboard(text: str) -> bool:
    """Four keyboard words in a row."""
    keys, run = set(KEYS.split()), 0
    for word in WORD.findall(text.lower()):
        run = run + 1 if word.rstrip("0123456789") in keys or (run and word.isdigit() and len(word) < 4) else 0
        if run >= 4:
            return True
    return False


def _latin(text: str, latin: frozenset[str] = frozenset(LATIN.split())) -> bool:
    """A sentence most of whose words are the filler's Latin: at least three of them, or nothing else."""
    words = [w.lower() for w in WORD.findall(text)]
    hits = sum(w in latin for w in words)
    return hits >= 2 and (hits == len(words) or (hits >= 4 and 2 * hits >= len(words)) or any(all(w in latin for w in words[i : i + 4]) for i in range(len(words) - 3)))


def families(text: str | None) -> list[str]:
    """Names of the families of residue a text holds."""
    if not text or text.isspace():
        return []
    machine, _ = _machine()
    met: set[str] = set()
    if _pseudo_language(text):
        met.add("filler")
    if not any(True for _ in machine.iter(text.lower())):
        return sorted(met)
    body = without_code(text)
    low = body.lower()
    if len(low) != len(body):  # a letter whose lower case is two: places must stay
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in body)
    cuts, at = [0], []
    for m in END.finditer(body):
        cuts.append(m.end())
    opened: dict[int, dict] = {}
    for end, (_, grammars) in machine.iter(low):
        i = bisect.bisect_right(cuts, end) - 1
        opened.setdefault(i, {}).update({(f, p): None for f, p in grammars})
    if LINES.search(body) or (" xx" in low or "xxx" in low) and XES.search(body) or _keyboard(body):
        met.add("filler")
    code = _indented(body) if opened else set()
    lines = sorted(code)
    mentions, marks = 0, 0
    for i, grammars in opened.items():
        to = cuts[i + 1] if i + 1 < len(cuts) else len(body)
        sentence = body[cuts[i] : to].strip()
        begun = body.rfind("\n", 0, cuts[i] + 1) + 1 if lines else 0
        in_code = bool(lines) and begun in code
        if not in_code and ("lorem" in sentence.lower() or "dolor" in sentence.lower() or "consectet" in sentence.lower()) and _latin(sentence) and not MENTION.search(sentence):
            met.add("filler")
        for family, pattern in grammars:
            if family in met and family != "placeholder":
                continue
            m = pattern.search(sentence)
            if m is None or (family == "placeholder" and in_code):
                continue
            rest = sentence[: m.start()] + " " + sentence[m.end() :]
            quoted = any(q.start() <= m.start() and m.end() <= q.end() and len(WORD.findall(sentence[: q.start()] + sentence[q.end() :])) > 2 and not (q.start() == m.start() and q[0][0] == "«") for q in QUOTES.finditer(sentence))
            if family == "placeholder":
                if quoted or MENTION.search(rest):
                    mentions += 1
                elif pattern.pattern != PLACEHOLDERS["<"] or f"</{m[0][1:]}" not in body:
                    marks += 1
            elif not quoted and not (family == "script" and HOW_TO.search(sentence)):
                met.add(family)
    if marks and not (mentions >= 2 and mentions >= marks):
        met.add("placeholder")
    return sorted(met)


def find_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, families of every row that holds residue."""
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [families(t) for t in batch.column(1).to_pylist()]
            keep = pa.array([bool(m) for m in met])
            found = pa.array([m for m in met if m], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), found], names=["key", "families"])

    return spread(slim).mapInArrow(run, f"key {kind}, families array<string>").withColumnRenamed("key", key)


def without_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``df`` that hold none; null, empty and blank texts stay. ``key`` must be unique."""
    found = find_residue(df, key, text).select(F.col(key).alias("__found"))
    return df.join(found, F.col(key) == F.col("__found"), "left_anti")
