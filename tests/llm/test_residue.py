"""Residue detection: texts that are residue, and texts that only write about it."""

import pytest

from ledgerloom.llm.residue import find_residue, without_residue

RESIDUE = [
    "Der Umsatz stieg um {{ umsatz_vj | upper }} %.", "Sitz ist ${ort}.", "<%= firma %>", "{% if datum %}", "am [TT.MM.JJJJ] fest", "[NAME DER GESELLSCHAFT]", "[●] reported", "[nom de la société]", "&lt;bitte ergänzen&gt;", "<Ort, Datum>", "«Sitz» und", "«Client.city»", "%UMSATZ_VJ%",
    "__SEGMENT__", "##COMPANY_NAME##", "@@datum@@", "_______________ (Datum)", "XX.XX.20XX", "[...] TEUR (bitte ergänzen)", "Lorem ipsum dolor sit amet", "Dies ist ein Blindtext.", "Text folgt.", "Hier Text eingeben", "tbd\n", "Content coming soon.", "xx xxx Xxxxx xxxx xx xxx", "abc 123 test test asdf test abc",
    "Muster Muster Muster.", "Absatz 1\nMuster 2\nSample paragraph 3", "Remqualu sitip remta talitcu tabis dome mebisqua cuvedono usquaqualit meusluus vetor. Quaemcutor remsittorlu norem.", "404 – Seite nicht gefunden", "Page introuvable", "Kein Treffer.", "We could not open the page: reset",
    "Die Trefferliste konnte leider nicht geladen werden.", "Interner Serverfehler.", "Bad Gateway", "Zugriff verweigert.", "Ihre Sitzung ist abgelaufen.", "Traceback (most recent call last):", "java.lang.IllegalStateException: no rows", "Accès refusé (403).", "Bitte aktivieren Sie JavaScript", "Ohne Skripte kann diese Seite nicht dargestellt werden.",
    "You need to enable JavaScript to run this app.", "Le contenu nécessite les scripts.", "JS gesperrt?", "Our application works only with scripting.", "Sorry, this page needs JavaScript.", "Guter Text davor. Inhalt folgt in Kürze. Guter Text danach.",
]
CLEAN = [
    None, "", "  ", "The web team replaced JavaScript widgets, which cut page errors (404) by 1.2%.", "Platzhalter im Musterbericht wurden vollständig ersetzt.", "Der Zähler __init__ und die Variable {x} des Prüfskripts sind im Handbuch beschrieben.", "Gesucht werden Fachkräfte mit Kenntnissen in JavaScript.",
    "Im Onlineshop führte ein Ausfall zeitweise zur Meldung „Fehler 404“; der Umsatzverlust betrug 5 EUR.", "Die Agentur liefert Blindtexte und Entwürfe für den Katalog.", "Die Angaben in eckigen Klammern [Vorjahr: 1,2] betreffen 3.", "champs vides entre crochets [voir note 3].", "Auf die Führung von TODO-Listen im Projekt Digital wird verzichtet.",
    "Access was denied to two bidders for lack of guarantees.", "Kapitel XX und XXI des Handbuchs gelten fort [1], [2].", "Formel: Quote = {Eigenkapital} / {Bilanzsumme}", "Als Umrechnung gilt <5 TEUR = 5.000 EUR>.", "Die Quote liegt bei <5,3 % und >7 %.", "Der Scanner setzt die Endmarke <|endoftext|> ans Seitenende.",
    "Weiterer Text folgt aus Ziffer 3 der Satzung.", "Das Testsystem (test, abc5) wurde mit 5 EUR aktiviert.", "Die Sitzung des Beirats ist um 12:30 Uhr abgelaufen.", "Der Serverausfall (HTTP 503) im Mai hatte keine Folgen.", "Das Dokumentensystem konnte im Juli an 3 Tagen nicht erreicht werden.", "Ein Muster der Vollmacht (Firma, Ort, Datum) liegt bei.",
    "ООО «Вельта», 株式会社ノルマ", "Les pages introuvables (404) ont été supprimées.", "In der Vorlage steht der Platzhalter „{{ name }}“ für den Kunden.", "Beispiel:\n```\n{{ name }} ${x}\n```\nEnde der Anleitung.", "Der Ausdruck `${ort}` wird ersetzt.", "=====-----=====",
]


# Texts of other domains than the tables', none of which the grammars name.
RESIDUE += [
    "Dear [Recipient], thank you for your order.", "Hallo <Vorname>, schön, dass Sie da sind!", "Invoice {invoice_number} is due.", "Diese Website benötigt JavaScript.", "You must have JavaScript turned on.", "404 Not Found nginx", "Error 503: upstream connect error",
    "Hi {{#if user}}there{{/if}}", "Lorem ipsum.", "asdf asdf 123 test qwertz", "Total: #{order_total}", "HTTP/1.1 502 Bad Gateway", "Scripting is disabled in your browser.", "Dear {first_name}, welcome back.", "consectetur adipiscing elit sed do eiusmod",
]
CLEAN += [
    "In Jinja the tag {{ name }} is replaced by the value of name.", 'Example: <code class="jinja">{{ name }}</code> is rendered.', "Example:\n~~~\n{{ name }} ${x}\n~~~\nEnd.", "Usage:\n\n    print({{ name }})\n\nThat is all.", "Text:\n```\n" + "x = 1\n" * 5_000 + "{{ name }}\n```\nEnd.",
    "The course shows how to enable JavaScript in Firefox for elderly users.", "The Lorem ipsum text derives from Cicero.", "We sell paint in red, green, blue, yellow, orange, purple, brown, black, white, grey, pink and beige.", "red, green, blue, yellow, orange, purple, brown, black, white, grey, pink",
    "Use `{{ x }}` and ```${y}``` inline.", "He wrote: \"access denied\" on the wall and left.", "The set {a, b} and the list [1, 2] stay.", "See the docs [Note] and <b>bold</b> text.", "<Betrag>5</Betrag>", "Wanted: developers who need JavaScript skills.",
    "Variables are written ${name}. A loop is {% for x in y %}. The syntax ${name} is escaped with a backslash. So ${other} works too.",
]


def test_residue_and_clean(spark):
    texts = RESIDUE + CLEAN
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k for r in find_residue(d, "k", "t").collect()}
    missed = [t for i, t in enumerate(RESIDUE) if i not in got]
    wrong = [t for i, t in enumerate(CLEAN) if i + len(RESIDUE) in got]
    assert (missed, wrong) == ([], [])
    assert {r.k for r in without_residue(d, "k", "t").collect()} == set(range(len(texts))) - got


@pytest.mark.parametrize("filler", ["wort ", "Ein Satz steht hier und dort. ", "{ [ < « % _ ", "\n "])
def test_very_long_texts(spark, filler):
    long = filler * 60_000
    d = spark.createDataFrame([(1, long + "\nText folgt."), (2, "Guter Anfang. " + long[:2000])], "k int, t string")
    assert 1 in {r.k for r in find_residue(d, "k", "t").collect()}


def test_empty_and_clashing(spark):
    d = spark.createDataFrame([], "k int, t string, body string, families string")
    assert find_residue(d, "k", "t").count() == 0
