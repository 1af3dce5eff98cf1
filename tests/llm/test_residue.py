import pytest

from tributary.llm.residue import residue, residue_kind

NORMAL = "The oak tray is checked by hand. Wash at 30 degrees and dry flat."
CASES = {
    "placeholder": [
        "Dear {{first_name}}, " + NORMAL, "Hallo *|VORNAME|*,", "Your order <%= id %> is on its way.", "Total due: ${amount_due}.", "Thanks, [SENDER]", "Hi @@name@@!", "Hello undefined, your parcel is on its way.",
        "Dear null,", "Your total is NaN.", "Items: [object Object], [object Object]", "Hi %s, thanks for order %d.", "Liebe/r NULL,", NORMAL + "\nBonjour %PRENOM%,", "Estimado «NOMBRE»:", "Dear <INSERT NAME>,",
    ],
    "filler": [
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", NORMAL + " Nisi ut aliquip ex ea commodo consequat duis.", "Body copy goes here", "TBD TBD TBD", "Your text here.", "asdf qwer hjkl", "Texte à venir", "Titel hier eintragen.",
        "INSERT TEASER TEXT", "Hier steht ein Blindtext für den Newsletter.",
    ],
    "page": [
        "404 Not Found", "<div class=\"x\"><p>Please enable JavaScript to continue using this shop.</p></div>", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "Esta página requiere cookies.", "Erreur 404 : la page demandée est introuvable.",
        "Access denied. You don't have permission to view this resource. Ref 1", "Checking your browser before opening shop.example. This takes 5 seconds.", "Traceback (most recent call last):\n  File \"render.py\", line 3, in build\nKeyError: 'block_1'",
        NORMAL + "\n\nSorry, this page does not exist.", "THE SHOP COULD NOT LOAD YOUR BASKET (CODE 5).",
    ],
    None: [
        None, "", "  \n ", NORMAL, "Put *|FNAME|* in the greeting so that the campaign fills in the name; {{first_name}} is the syntax of the other tool.", "Her reply began with 'Dear null' because our first mail did; we apologised.",
        "The value null in core.orders means that no match was made; undefined tiers count as bronze.", "SELECT count(*) FROM t WHERE batch_id = ${BATCH_ID} is what the nightly check runs.", "The buyer saw a 404 page at checkout; the order went through.",
        "The job stopped with '502 Bad Gateway' from the catalogue host, Ann raised the timeout and it has run since.", "He keeps JavaScript switched off, so our tracker never fires; we explained how to enable it and he agreed.",
        "Cookies (the baked ones) come free with each hemp rug.", "The Lorem candle smells of cedar.", "The placeholder image in the listing was replaced.", "<|endoftext|> " + NORMAL, "x" * 200_000,
    ],
}


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in CASES.items() for t in ts])
def test_kinds(kind, text):
    assert residue_kind(text) == kind


def test_operator(spark):
    rows = [(1, "404 Not Found", "a"), (1, "404 Not Found", "a"), (2, NORMAL, "b"), (None, "Dear null,", "c"), (3, None, "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    assert sorted((r.doc_id or 0, r.kind) for r in residue(df).collect()) == [(0, "placeholder"), (1, "page"), (1, "page")]
    assert residue(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", [" ".join(["blah"] * 20), " ".join(["tbd"] * 20), NORMAL + "\n" + " ".join(["insert your text here"] * 5)])
def test_long_filler_without_full_stops(text):
    assert residue_kind(text) == "filler"


HELD_OUT = {
    "page": [
        "Oops! We were unable to load your account page. Please try again later. Error code: 9f2c.", "This site requires cookies and scripts. Please allow cookies in your browser settings.",
        "503 Service Unavailable\nNo healthy backend\nRequest ID: 77aa-01", "Diese Seite funktioniert nur mit JavaScript.", "La page demandée est introuvable.", "La tienda no está disponible. Inténtelo más tarde.",
        'Traceback (most recent call last):\n  File "/srv/app/views.py", line 9, in handler\nKeyError: \'cart\'', "books.example.org sent no data.", NORMAL + "\n\nAccess denied.",
    ],
    "filler": [
        "Lorem ipsum dolor sit amet", "Platzhaltertext", "Insert your headline here", " ".join(["Add a short caption here"] * 12), "Texto de relleno.", "zzzz zzzz xxxx",
        " ".join("dolore magna aliqua enim minim veniam quis nostrud".split() * 8),
    ],
    "placeholder": ["Dear {{ customer.full_name_as_given_in_the_account_form_of_the_third_step_of_registration }},", "Hola *|NOMBRE|*:", "Montant : NaN Le colis est parti.", "Betrag: (null)", "{% greeting %}", "Hi [FIRST NAME]!", "Bonjour %PRENOM%, merci."],
    None: [
        "The cafe's page on cookies: ours are baked daily with oats, and no browser is needed to enjoy them.", "Ann said the shop showed 'Access denied' for a minute, then it worked and Ben paid.",
        "In the template language {{name}} is the placeholder for the customer's name.", "Use [[wiki link]] syntax for pages that mention our suppliers.", "SELECT * FROM t WHERE a = ${A}", "Hi Ann, none of the mugs arrived broken.",
        "Null Toleranz gilt bei Hygiene.", "The loan was not found to be invalid by the court in Rome, which heard three experts on it.",
    ],
}


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in HELD_OUT.items() for t in ts])
def test_held_out_shops_and_languages(kind, text):
    assert residue_kind(text) == kind


@pytest.mark.parametrize("text", ["{" * 20_000, "%" * 20_000, "[A" * 20_000, "%a " * 20_000, "«a" * 20_000, "null " * 20_000, "not found. " * 20_000, "lorem " * 3 + "x " * 50_000])
def test_long_texts_take_linear_time(text):
    import time

    began = time.perf_counter()
    residue_kind(text)
    assert time.perf_counter() - began < 3
