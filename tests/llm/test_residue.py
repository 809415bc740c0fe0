import pytest

from quarry.llm.residue import residue, residue_of, without_residue

BODY = "The second attempt with pinned threads was steady and the loop ended after 48 steps. We kept the snapshot and dropped the read set."

RESIDUE = {
    "placeholder": [
        f"Dear {{{{ first_name }}}},\n{BODY}", f"Report for {{{{{{figure}}}}}}\n{BODY}", f"{BODY} On ${{VERSION}} we saw 3.2 of them.", "Prepared by <%= author %>", "Last changed: %START_DATE%", "See [[PROJECT]] for the row.",
        "Hello [your name],", "Copyright [COMPANY HERE], the team.", "Date: <insert date>", "Date: <YOUR_DATE>", "For @@METRIC@@ it stayed flat.", "Please send remarks to @AUTHOR@.", "By __AUTHOR__ and others", "# XX_TITLE_XX",
        "Generated for «Contact» today.", "Generated for <<Contact>> today.", "Dear ~Name~,", "The array of (user name to be filled in) was steady.", "See %(version)s for it.", "{% block title %}", "See #{run_id} for it.", "Use $(version) of it.", "Dear {name},", "By $TITLE$ of them",
        "Hello [Recipient Name], thanks.", "Welcome to [Company].", f"Dear ___________,\n{BODY}", f"{BODY}\n\n    Dear {{name}},\n    thanks for the log", "Yours, [Your Company Name]",
    ],
    "filler": [
        f"Background\nLorem ipsum dolor sit amet, consectetur adipiscing elit.\n\n{BODY}", "xxx xxx xxx xxx xxx xxx", "bla bla\nbla bla\nbla bla", f"{BODY}\n\nResults\nSample text goes here.", "Texto de relleno. Texto de relleno.", "Hier steht bald ein Text.",
        "abc, abc, abc, abc, abc, abc, abc", "lqe qef fjfs;j wdael sa;k;q;a wd; kqwawjq ;lrar;ae laqald;", "Replace this paragraph with your own words.",
        f"{BODY}\nBackground\n" + "word\n" * 14, f"{BODY}\nAbstract\n" + "foo bar\n" * 9, "Testo segnaposto.", "Dit is een voorbeeldtekst.", "jeeler erkajlr qsqlaeje qww jwdfedf jjqsdasr fwkrsj qkweak esw asrfaa",
    ],
    "stub": ["Coming soon!", f"Title\n\nSetup\nNothing has been written here yet ...\n\n{BODY}", "Diese Seite ist im Aufbau", "Página en construcción.", "This section is left as a stub", "TBD", "Questa pagina è in costruzione.", "Deze pagina is nog in aanbouw", "Página em construção", "Strona w budowie"],
    "notice": [
        "404 Not Found", "Menu\nBoards\nHelp\nOops! The request timed out.\nRecent threads\n* Notes on taking the snapshot\n* Why it depends", "Please enable JavaScript to view this page.", "<html><head><title>403 Forbidden</title></head><body><h1>Forbidden</h1><hr><center>webd/1.2</center></body></html>",
        '{"status": 429, "message": "You have sent too many requests."}', "Checking your browser before opening the board.\nThis usually takes a few seconds.", "Bitte JavaScript einschalten, um die Seite anzuzeigen.", "NO SUCH THREAD.\nERROR CODE: 404", "<noscript>JavaScript is needed to display the thread.</noscript>\n© the site",
        "    <html>\n    <body>\n        <h1>404 Not Found</h1>\n    </body>\n    </html>", "Threads\nMembers\nGallery\nYou need to enable JavaScript to run this app.",
        "Please enable JavaScript in the settings of your browser, since this site requires scripts to load the pages, to display the content and to verify that your device is supported, and then reload the page or contact the administrator of the site.",
        f"<p class='{'x' * 400}'>502 Bad Gateway</p>",
    ],
}

CONTENT = [
    None, "", "  \n ", BODY, "Fixed.", "See run 8.",
    "The page template prints `{{ title }}` literally when the cache is cold.",
    "The mail merge left %NAME% in the invitations last year; this report is about the bucket.",
    "The ${HOME} in the job file was mine, sorry.",
    f"{BODY}\n\n```\necho \"run $RUN of ${{TOTAL}}\" >> bench.log\n```",
    f"{BODY}\n\n    export OUT=${{HOME}}/bench/{{name}}\n    // TODO: try it\n",
    "std::map<std::string, Slot<K, W>> was replaced by a flat array.",
    'The format string "%s=%d" in the logger costs 3.2 MB.',
    f"We tried the lorem ipsum generator as input. {BODY}",
    "Error 504 is gone since the proxy was replaced on bench host two.",
    "Scripts are enabled again in the nightly job.",
    "The viewer needs JavaScript for the plots, but the cost is also in the log.",
    f"Home | Docs | Lists\nThis site requires JavaScript to work.\n\n{BODY}",
    "Not found in the log of run 3, closing.",
    "TODO for the next round: compare the latency at the tail.",
    "He wrote \"Dear {name},\" and meant it.",
    "x" * 200_000,
    "Why the sparse sweep shadows the sparse sweep", "Why the worker thread shadows the worker thread",
    "The item [12] and the note [Smith] agree; see [RFC] and [the log](name).",
    "Merge fields for beginners\nA template holds merge fields. Write {{ name }} where the name should go. Put {{ date }} below it.\nThe placeholder is replaced when the letter is sent. Run it twice.",
    f"{BODY}\n\n    for x in rows:\n        print({{x}})\n",
    "Fill the gap: the capital of France is ______.",
    "Access to the table was denied in run 7 since the huge pages of the second socket were already taken by the loader when the sweep began, so we moved the loader to the other socket and measured the whole thing again.",
]


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in RESIDUE.items() for t in ts])
def test_residue(kind, text):
    got = residue_of(text)
    assert got and got[0] == kind


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    assert residue_of(text) is None


def test_line_ends_and_case():
    assert residue_of("MENU\r\nBOARDS\r\nTHE REQUEST TIMED OUT.")[0] == "notice"
    assert residue_of("title\r\n\r\ncoming soon")[0] == "stub"


def test_frame(spark):
    docs = spark.createDataFrame([(1, "Coming soon", "a"), (2, BODY, "b"), (None, "Coming soon", "c"), (3, None, "d")], "doc_id long, text string, kind string")
    assert [tuple(r) for r in residue(docs, "doc_id", "text").collect()] == [(1, "stub", "Coming soon")]
    assert without_residue(docs, "doc_id", "text").count() == 3
    assert residue(docs.limit(0), "doc_id", "text").count() == 0
