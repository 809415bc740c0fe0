"""Template residue, filler and error pages.

A text is read line by line outside of code. Three grammars look for residue:

* placeholders, one pattern per delimiter style, in running text; discounted in code blocks, inline
  code, quotations and sentences that talk about templates, and in a tutorial: a text with several
  placeholders in which a good share of all sentences (``TUTORIAL_SHARE``) is such talk;
* filler (dummy words, repeated tokens, keyboard mash, stock phrases) and stub notices that make up a
  whole sentence or line, be it in one section only;
* error pages and script or robot notices, if nothing but the site's menus, links and thread lists
  is left besides them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[._\- ][A-Za-z0-9]+){0,4}"
_UPPER = r"[A-Z][A-Z0-9]*(?:[_ \-][A-Z0-9]+){0,4}"

#: Delimiter-specific grammars of unfilled placeholders.
PLACEHOLDERS = [
    re.compile(p)
    for p in (
        rf"\{{\{{\{{?\s*[#/>&^!]?\s*{_NAME}(?:\s*\|[^{{}}\n]{{0,40}})?\s*\}}?\}}\}}",  # {{ name }}, {{{name}}}
        rf"\{{%-?\s*(?:{_NAME})[^%\n]{{0,60}}-?%\}}",  # {% block name %}
        rf"<%[=\-#]?\s*{_NAME}(?:\([^)\n]*\))?\s*-?%>",  # <%= name %>
        rf"[$#]\{{\s*{_NAME}(?::[^{{}}\n]{{0,30}})?\s*\}}",  # ${name}, #{name}
        rf"\$\(\s*{_NAME}\s*\)",  # $(name)
        rf"(?<![\w\\$#{{])\{{{_NAME}\}}(?!\}})",  # {name}
        rf"%\({_NAME}\)[sdfr]",  # %(name)s
        r"(?<![\w%])%[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*%(?!\w)",  # %NAME%
        r"(?<![\w$])\$[A-Z][A-Z0-9]{2,}(?:_[A-Z0-9]+)*\$(?![\w$])|(?<![\w$])\$[a-z][a-z0-9]*(?:_[a-z0-9]+)+\$(?![\w$])",  # $NAME$
        r"(?<![\w.@])@@?[A-Z][A-Z0-9]{2,}(?:_[A-Z0-9]+)*@@?(?![\w@])|(?<![\w.@])@@?[a-z][a-z0-9]*(?:_[a-z0-9]+)*@@?(?![\w@.])",  # @NAME@, @@NAME@@
        r"(?<!\w)__[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)*__(?!\w)|(?<!\w)__[a-z][a-z0-9]*(?:_[a-z0-9]+)+__(?!\w)",  # __NAME__
        r"\bXX_[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*_XX\b|\bxx_[a-z][a-z0-9]*(?:_[a-z0-9]+)*_xx\b",  # XX_NAME_XX
        r"\[\[\s*[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*\s*\]\]|\[\[[a-z][a-z0-9]*(?:_[a-z0-9]+)+\]\]",  # [[NAME]]
        rf"\[\s*(?:insert|your|enter|add|put|fill in|type|INSERT|YOUR|ENTER|Insert|Your|Enter)\s+{_NAME}\s*\]",  # [insert name here], [your name]
        rf"\[\s*{_UPPER} HERE\s*\]|\[\s*[a-z][a-z0-9]*(?: [a-z0-9]+){{0,3}} here\s*\]",  # [NAME HERE]
        rf"<\s*(?:insert|your|enter|INSERT|YOUR|ENTER|Insert|Your|Enter)[ _\-]{_NAME}\s*>",  # <insert name>, <YOUR_NAME>
        r"<<\s*[A-Za-z][A-Za-z0-9_]*(?: [A-Za-z0-9_]+)?\s*>>",  # <<Name>>
        r"«[A-Za-z][A-Za-z0-9_]*»",  # «Name»
        r"(?<![\w~])~[A-Z][A-Za-z0-9]*~(?![\w~])|(?<![\w~])~[a-z]{3,}~(?![\w~])",  # ~Name~
        rf"[(\[<]\s*(?:{_NAME}) (?:to be (?:filled in|added|supplied|inserted|completed)|goes here)\s*[)\]>]",  # (name to be filled in)
        rf"(?i:[(\[<]\s*{_NAME} to be filled in\s*[)\]>])",
    )
]
#: What a slot in plain square brackets is for; only such names tell it from notes and references.
_SLOT = r"(?i:names?|company|organi[sz]ation|employer|recipient|sender|client|customer|patient|manager|addressee|date|address|e-?mail|phone|number|title|position|department|signature|city|country|street|amount|product|project|author|university|school|venue|location|website|invoice)"
PLACEHOLDERS += [
    re.compile(rf"\[\s*(?:[A-Z][\w'’.]*[ /])+{_SLOT}\s*\](?![(:\[])"),  # [Recipient Name]
    re.compile(rf"(?<=[A-Za-z,:] )\[\s*(?=[A-Z]){_SLOT}\s*\](?![(:\[])"),  # Welcome to [Company]
    re.compile(r"(?i:^[ \t>]*(?:dear|hello|hi|to|from|date|name|signed|subject|attn|sincerely|regards|title|company|phone|address)\b[^.!?_\n]*?(?<=[\s:]))_{4,}", re.M),  # Dear ______,
]
_ANY_PLACEHOLDER = re.compile("|".join(f"(?:{p.pattern})" for p in PLACEHOLDERS))
#: Every placeholder contains one of these; plain substring tests, as most texts have none.
_MARKS = ("____", "{", "<%", "$", "%(", "%", "@", "__", "[[", "<<", "«", "~", "XX_", "xx_", "Xx_")
_MARK_WORDS = ("[insert", "[your", "[enter", "[add", "[put", "[fill", "[type", "[ ", " here]", " here ]", "<insert", "<your", "<enter", "< insert", "< your", "to be filled", "to be added", "to be supplied", "to be inserted", "to be completed", " goes here)", " goes here]", " goes here>")


_SLOT_MARK = re.compile(rf"\[[^\[\]\n]*{_SLOT}\s*\]")


def _may_hold_placeholder(text: str, low: str) -> bool:
    return any(m in text for m in _MARKS) or any(m in low for m in _MARK_WORDS) or ("[" in text and _SLOT_MARK.search(text) is not None)


#: Shell variables that running text names as they are.
_ENVIRONMENT = re.compile(r"[$%#][{(]?\s*(?:HOME|PATH|PWD|SHELL|TMPDIR|TEMP|LANG|JAVA_HOME|LD_LIBRARY_PATH|PYTHONPATH|APPDATA|USERPROFILE)\b", re.I)
#: Words by which a sentence talks about templates instead of being one.
_ABOUT = re.compile(r"\b(?:templates?|templating|placeholders?|mail ?merge|job file|build file|config(?:uration)? file|format string|escap(?:e|ed|ing)|literal(?:ly)?|syntax|substitut\w+|interpolat\w+|environment variables?|variables?|macros?|merge fields?|expands? to|expanded|jinja|mustache|vorlage|platzhalter|modèle|plantilla)\b", re.I)

_FENCE = re.compile(r"^\s{0,3}(?:>\s?)*(```|~~~)")
_INLINE_CODE = re.compile(r"``[^`\n]+``|`[^`\n]+`|<code>.*?</code>|<pre>.*?</pre>", re.I | re.S)
_QUOTED = re.compile(r"\"[^\"\n]+\"|“[^”\n]+”|„[^“”\n]+[“”]")
_INDENTED = re.compile(r"^(?: {4,}|\t)\S")
#: Indented lines that are no code by themselves: markup, or words without the signs of code.
_MARKUP_LINE = re.compile(r"^\s*<[/!?a-z]", re.I)
_CODE_SIGNS = re.compile(r"[;={}()\\|&$`]|::|->|>>|//|--\w|\w\.\w+\(|^\s*(?:#|\w+:$|-\w)|/\w+/")
#: Share of a text's sentences that must talk about templates for it to count as a tutorial.
TUTORIAL_SHARE = 0.15
_SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]]*\s+")

#: The vocabulary of Latin dummy text, whole and cut short.
LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur consec adipiscing adipis adipisicing elit sed do eiusmod tempor incididunt incid ut labore et dolore magna
    aliqua enim ad minim veniam quis nostrud exercitation ullamco ullam laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit
    voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id
    est laborum porta nunc augue vel vivamus praesent pellentesque curabitur vestibulum mauris tincidunt""".split()
)
_DUMMY = frozenset("xxx xx xxxx bla blah blabla foo bar baz qux abc abcd text test testing asdf asdfasdf qwerty qwertz dummy lorem sample placeholder".split())

_END = r"\s*(?:\.{1,3}|…|!+|:)?\s*$"
_FILLER = re.compile(
    r"^(?:(?:this is |here is )?(?:a |some |just )?(?:dummy|sample|placeholder|filler|example|test|temporary) (?:text|copy|content|paragraph|sentence)(?: (?:goes|comes|stands) here)?(?: only)?"
    r"|(?:your |the |some )?(?:own )?(?:text|heading|headline|title|content|caption|body|paragraph|description|image|picture|subtitle|quote)(?: text)? (?:goes|comes|stands) here"
    r"|(?:your|enter|insert|type|add|put)(?: your| some)? (?:text|heading|title|content|caption|description|message) here|caption text|heading text|body text"
    r"|(?:please )?replace this (?:paragraph|text|sentence|section|content|placeholder)(?: (?:with|by) .{1,40})?"
    r"|(?:the )?text (?:of|for) (?:this|the) (?:section|chapter|page|paragraph) (?:follows|comes|will follow|to follow)(?: later| soon| shortly)?"
    r"|1 2 3 test(?:ing)?|test(?:ing)? 1 2 3|test test(?: test)*"
    r"|hier (?:steht|folgt|kommt|erscheint) (?:bald|später|demnächst|noch)?\s?(?:ein|der|mehr)? ?(?:text|inhalt)|blindtext|platzhaltertext|beispieltext|dies ist (?:ein )?(?:blind|beispiel|platzhalter)text"
    r"|texte (?:provisoire|factice|de remplissage|à venir|d'exemple)|faux[- ]texte|ceci est un (?:texte )?(?:faux[- ]texte|provisoire|exemple)"
    r"|texto (?:de relleno|provisional|de ejemplo|de prueba|simulado|ficticio)|este es un texto de (?:relleno|ejemplo|prueba))" + _END,
    re.I,
)
#: Further languages: stub notices and filler as data, one list each.
MORE_STUBS = {
    "it": ["(?:questa )?(?:pagina|sezione) (?:è )?in (?:costruzione|allestimento|preparazione)", "in costruzione", "(?:contenuto|testo) (?:in arrivo|da completare)", "prossimamente"],
    "pt": ["(?:esta )?(?:página|secção|seção) (?:está )?em (?:construção|obras|preparação)", "em construção", "(?:conteúdo|texto) em breve", "em breve"],
    "nl": ["(?:deze )?(?:pagina|sectie) is (?:nog )?in (?:aanbouw|voorbereiding|opbouw)", "in aanbouw", "(?:inhoud|tekst) volgt(?: binnenkort| later)?", "binnenkort beschikbaar"],
    "pl": ["(?:ta )?strona (?:jest )?w (?:budowie|przygotowaniu)", "w budowie", "wkrótce"],
    "sv": ["(?:denna |den här )?sida(?:n)? är under (?:uppbyggnad|konstruktion)", "under uppbyggnad", "kommer snart"],
}
MORE_FILLER = {
    "it": ["testo (?:segnaposto|di prova|di esempio|fittizio)", "questo è un testo di (?:prova|esempio)"],
    "pt": ["texto (?:de exemplo|provisório|fictício)", "este é um texto de (?:exemplo|teste)"],
    "nl": ["(?:dit is )?(?:een )?(?:voorbeeldtekst|opvultekst|dummytekst|proeftekst)"],
    "pl": ["(?:to jest )?(?:przykładowy|zastępczy) tekst"],
    "sv": ["(?:detta är )?(?:en )?(?:exempeltext|platshållartext)"],
}
_STUB = re.compile(
    r"^(?:(?:this|the) )?(?:coming (?:very )?soon|(?:page|section|site|chapter|content|text|document|more|details|description|article) (?:is |are )?(?:coming soon|coming shortly|under construction|being (?:written|prepared|reworked)|to follow|to come)"
    r"|under construction|work in progress|(?:more |the )?(?:content|text|details|information|description) (?:will be|is to be|are to be|to be) (?:added|written|provided|supplied|completed|inserted)(?: here)?(?: shortly| soon| later)?"
    r"|(?:content|text|details|section) (?:follows|follow|comes|to follow)(?: shortly| soon| later)?"
    r"|nothing (?:has been|was|is) (?:written|added|entered|posted) here(?: yet| so far)?|nothing (?:to see )?here(?: yet)|no (?:content|text|description) (?:has been (?:written|added|provided)|available|yet)(?: here)?(?: yet)?"
    r"|(?:this )?(?:section|page|chapter|article|document) (?:is |has been |was )?(?:intentionally )?left (?:blank|empty|as a stub)(?: intentionally)?|(?:this )?(?:section|page|chapter|article|document) is (?:a stub|empty)|intentionally left blank"
    r"|(?:section|text|page|content|still)? ?(?:to be (?:written|done|added|determined|completed|announced|continued|supplied)|tbd|tba|tbw|todo)"
    r"|(?:diese |die )?(?:seite|rubrik|abschnitt)(?: (?:ist|befindet sich))? (?:noch )?im aufbau|im aufbau|(?:inhalt|text) folgt(?: in kürze| bald| später| demnächst)?|dieser abschnitt (?:ist noch leer|folgt)|(?:noch )?in (?:arbeit|vorbereitung)"
    r"|(?:cette |la )?(?:page|section|rubrique)(?: est)? (?:actuellement )?en (?:construction|travaux|cours de rédaction)|en construction|(?:contenu|texte|section) à (?:venir|compléter|rédiger)|bientôt disponible|rien n'a encore été écrit(?: ici)?"
    r"|(?:esta |la )?(?:página|sección|pagina)(?: está)? en (?:construcción|construccion|obras|preparación)|en construcción|próximamente|proximamente|(?:contenido|texto|sección) (?:próximamente|pendiente|por (?:añadir|escribir|completar))|todavía no (?:hay|se ha escrito) (?:nada|contenido)(?: aquí)?)" + _END,
    re.I,
)

_MORE = [("filler", re.compile("^(?:" + "|".join(p for x in MORE_FILLER.values() for p in x) + ")" + _END, re.I)), ("stub", re.compile("^(?:" + "|".join(p for x in MORE_STUBS.values() for p in x) + ")" + _END, re.I))]
_STATUS = r"(?:bad request|unauthorized|payment required|forbidden|(?:page |file |document )?not found|method not allowed|not acceptable|request time-?out|conflict|gone|payload too large|too many requests|internal server error|server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|access denied|error)"
_SCRIPTS = r"(?:(?:client[- ]side |java ?)?scripts?|java ?script|js|scripting|cookies(?: and (?:java ?script|js|scripts))?|(?:java ?script|js) and cookies)"
_NOTICE = re.compile(
    "|".join(
        (
            rf"^(?:http(?:/\d\.\d)?|error|fehler|erreur|status|code)?[ :#]*[45]\d\d\b[ :,.\-–—|]*{_STATUS}?{_END}",
            rf"^(?:http )?{_STATUS} ?(?:\(? ?(?:error |http |code )*[45]\d\d ?\)?)?(?: [a-z][\w\-]*/[\d.]+| nginx| apache)?{_END}",
            rf"^(?:http(?:/\d\.\d)?|error|fehler|erreur)?[ :#]*[45]\d\d\b.{{0,3}}{_STATUS}\b.{{0,24}}$",
            r"^(?:oops|whoops|uh[- ]oh|sorry)\b.{0,20}$|^something (?:went|has gone) wrong\b|^an? (?:unexpected |unhandled |internal )?(?:error|exception) (?:has )?occurred",
            r"\b(?:page|document|address|url|thread|file|resource|site|link|board)\b.{0,40}\b(?:(?:could|can)(?: ?not|'t) be (?:found|located|displayed|reached)|was not found|not found|does(?: not|n't) exist|(?:was|has been|were) (?:moved|deleted|removed|archived)|is no longer (?:served|available)|no longer exists|is unreachable|is down for maintenance|is (?:currently |temporarily )?(?:unavailable|offline|down)\b)",
            r"^access (?:to .{1,40} )?(?:was |is |has been )?(?:denied|forbidden|blocked|restricted)|\byour (?:address|ip|ip address|request|connection) (?:has been|was|is) (?:blocked|banned|denied|rejected)|\byou (?:are not|aren't|do not have|don't have) (?:allowed|permitted|authori[sz]ed|permission|access)\b.{0,40}$|^(?:members|subscribers) only|^please (?:log|sign) in\b.{0,30}$|^no such (?:thread|page|file|board|user|document|address)\b.{0,20}$|\byou (?:must|need to|have to) (?:sign|log) in\b|\byour session (?:has )?expired",
            r"\brate limit (?:reached|exceeded)|\byou have sent too many requests|^too many requests|^we are over capacity|\bover capacity\b.{0,20}$|^the (?:upstream )?(?:server|service|site|request)\b.{0,30}\b(?:took too long|sent an invalid|met an unexpected|timed out|is (?:down|overloaded|unavailable|not responding)|encountered|could not)|^(?:we )?(?:could not|cannot|can't|unable to) connect to the (?:database|server|site)|\bis down for maintenance",
            rf"^(?:please |to continue,? (?:please )?|you (?:must|need to|have to) |then )*(?:please )?(?:enable|allow|activate|turn on|switch on) {_SCRIPTS}\b",
            rf"\b(?:site|page|app|application|forum|website|viewer|content|thread|board)s? (?:requires?|needs?) {_SCRIPTS} (?:to|in order to) (?:work|run|function|display|load|be)",
            rf"\bbrowser (?:does not|doesn't|cannot) (?:support|run|execute) {_SCRIPTS}|^(?:it (?:looks like|seems that|appears that) )?{_SCRIPTS} (?:is|are|seems? to be|appears? to be) (?:disabled|switched off|turned off|blocked|not enabled|off)\b|^without {_SCRIPTS},? .{{0,40}}\b(?:cannot|can't|will not|won't|does not)\b|^{_SCRIPTS} must be (?:enabled|on|allowed|switched on|turned on)|^{_SCRIPTS} (?:is|are) (?:needed|required) to (?:display|view|see|use|run|show)",
            r"\b(?:checking|verifying) (?:your|the) browser|\b(?:verify|verifying|confirm|prove|check|checking) (?:that )?(?:if )?you are (?:not a (?:ro)?bot|(?:a )?human)|^just a moment|^(?:please )?(?:complete|solve) the (?:captcha|security check)|\bddos protection by",
            rf"^bitte .{{0,20}}{_SCRIPTS}.{{0,20}} (?:einschalten|aktivieren|zulassen|erlauben)|{_SCRIPTS} (?:ist|sind) (?:deaktiviert|ausgeschaltet|abgeschaltet)|^(?:die |diese )?(?:gesuchte |angeforderte )?(?:seite|datei|adresse).{{0,30}}(?:nicht gefunden|nicht verfügbar|existiert nicht|gibt es nicht)|^zugriff (?:verweigert|gesperrt)|^(?:ein )?interner (?:server)?fehler|^der (?:dienst|server) ist .{{0,30}}(?:nicht (?:verfügbar|erreichbar)|überlastet)",
            rf"^(?:merci d'|veuillez |vous devez )(?:activer|autoriser) {_SCRIPTS}|^(?:cette |la )?page.{{0,30}}(?:est introuvable|n'existe pas|introuvable)|^accès (?:refusé|interdit)|^le (?:service|serveur) est .{{0,30}}(?:indisponible|surchargé)|^erreur interne|{_SCRIPTS} est désactivé",
            rf"^(?:por favor,? )?(?:active|habilite|activa|habilita|debe activar) {_SCRIPTS}|^(?:la |esta )?página.{{0,30}}(?:no existe|no (?:se )?(?:ha sido |fue |pudo ser )?encontrad[ao]|no encontrada|no está disponible)|^acceso (?:denegado|prohibido)|^el (?:servicio|servidor) (?:no está disponible|está .{{0,20}}(?:caído|saturado))|^error interno",
        )
    ),
    re.I,
)
_AFTER_NOTICE = re.compile(
    rf"^(?:see your browser'?s? help|(?:then )?(?:please )?(?:refresh|reload)\b.{{0,50}}|this (?:usually )?(?:takes|may take) .{{1,30}}|(?:please )?try again\b.{{0,30}}|(?:please )?(?:return|go back|back) to .{{1,40}}|(?:please )?contact (?:the|your) .{{1,50}}|(?:please )?check (?:the|your) .{{1,50}}|use the search\b.{{0,30}}|a plain version .{{1,30}}|error code[: ]+\S+|(?:request|ray|incident|reference|trace) ?(?:id)?[: ]+\S+|you will be redirected .{{1,30}}|redirecting.{{0,20}}|we are sorry|we apologi[sz]e.{{0,50}}|sorry.{{0,30}}|thank you.{{0,40}}|(?:enable|allow) .{{1,40}} and reload|http \d{{3}}|status[: ]+\d{{3}}|bitte .{{0,40}}(?:erneut|später|neu laden).{{0,30}}|veuillez .{{0,40}}(?:réessayer|recharger).{{0,30}}|(?:por favor,? )?(?:inténtelo|intente|recargue).{{0,40}}){_END}",
    re.I,
)
_CHROME = re.compile(
    r"^(?:menu|help|home|docs?|lists?|search|terms|privacy|contact|about|imprint|impressum|faq|login|log in|log out|sign in|sign up|register|subscribe|skip to (?:main )?content|(?:back|return) to (?:the )?(?:start page|top|home(?: page)?|index)|recent (?:threads|posts|topics)|other (?:boards|threads|topics)|you may also like|related(?: threads| topics| posts)?|(?:next|previous)(?: page| thread)?|sitemap|share|print|archive|feed|rss|newsletter|categories|tags)$",
    re.I,
)
_LIST_HEAD = re.compile(r"^(?:recent|other|related|similar|popular|latest|more|you may also like)\b[\w ]{0,30}:?$", re.I)
_BULLET = re.compile(r"^\s*(?:[*\-•·+]|\d+[.)])\s+")
_WORD = re.compile(r"[^\W\d_]+")
_TAG = re.compile(r"<[^<>]+>")
_STRUCTURE = re.compile(r"</?(?:html|head|body|title|noscript|h[1-6]|p|hr|br|center|div|span|meta|link|style|script)\b[^<>]*>", re.I)


def visible_lines(text: str) -> list[tuple[str, bool]]:
    """Lines with a flag that tells code (fenced or indented) from text; inline code is blanked."""
    out = []
    fence = None
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    for line in lines:
        if not fence and line[:1] not in _LINE_STARTS:
            out.append((line, False))
            continue
        m = _FENCE.match(line)
        if m:
            fence = None if fence == m[1] else fence or m[1]
            out.append((line, True))
        else:
            out.append((line, bool(fence)))
    if fence:  # an unclosed fence encloses nothing
        out = [(x, False) for x in lines]
    if "\t" in text or "    " in text:
        out = _mark_indented(out)
    if "`" in text or "<code" in text or "<pre" in text:
        out = [(x if c else _INLINE_CODE.sub(lambda m: " " * len(m[0]), x), c) for x, c in out]
    return out


def _mark_indented(lines: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """An indented block is code if any of its lines looks like code or a colon leads up to it."""
    out: list[tuple[str, bool]] = []
    block: list[str] = []
    before = ""

    def close() -> None:
        bare = [_ANY_PLACEHOLDER.sub(" ", x) for x in block]
        code = before.rstrip().endswith(":") or any(_CODE_SIGNS.search(x) for x in bare if not _MARKUP_LINE.match(x))
        out.extend((x, code and not _MARKUP_LINE.match(x)) for x in block)
        block.clear()

    for line, code in lines:
        if not code and _INDENTED.match(line):
            block.append(line)
            continue
        if block:
            close()
        out.append((line, code))
        if line.strip():
            before = line
    if block:
        close()
    return out


_LINE_STARTS = frozenset(" \t`~>")


def find_placeholder(lines: list[tuple[str, bool]]) -> str | None:
    """The first placeholder that stands unfilled in running text."""
    about_before, tutorial = False, None
    for line, code in lines:
        if code or not line.strip():
            continue
        bare = _QUOTED.sub(lambda m: " " * len(m[0]), line) if '"' in line or "“" in line or "„" in line else line
        if _may_hold_placeholder(bare, bare.lower()):
            for m in _ANY_PLACEHOLDER.finditer(bare):
                a = max((s.end() for s in _SENTENCE.finditer(line, 0, m.start())), default=0)
                b = _SENTENCE.search(line, m.end())
                rest = line[a : m.start()] + " " + line[m.end() : b.start() if b else len(line)]
                if _ENVIRONMENT.match(m[0]) or _ABOUT.search(_ANY_PLACEHOLDER.sub(" ", rest)):
                    continue
                if about_before:  # an example that a sentence about templates leads up to
                    continue
                if tutorial is None:
                    tutorial = _is_tutorial(lines)
                if tutorial:
                    return None
                return m[0].strip()
        about_before = line.endswith((":", ": ")) and bool(_ABOUT.search(line))
    return None


def _is_tutorial(lines: list[tuple[str, bool]]) -> bool:
    """Several placeholders, code included, and talk about templates in a good share of the sentences."""
    held = sum(len(_ANY_PLACEHOLDER.findall(x)) for x, _ in lines)
    if held < 2:
        return False
    parts = [p for x, code in lines if not code and x.strip() for p in _SENTENCE.split(_ANY_PLACEHOLDER.sub(" ", x)) if p.strip()]
    about = sum(1 for p in parts if _ABOUT.search(p))
    return about >= 2 and about >= TUTORIAL_SHARE * len(parts)


def _repeats(words: list[str]) -> bool:
    """One or two tokens over and over."""
    if len(words) < 4:
        return False
    kinds = set(words)
    if len(kinds) > 2:
        return False
    return kinds <= _DUMMY or (len(words) >= 8 and all(len(k) <= 12 for k in kinds))


#: Letters that no word of a living language puts side by side, or a word without a vowel.
_HARD = re.compile(r"q(?!u)|j[^aeiouy\W]|[^aeiouy\W\d_]{4}|(?<!\w)[^aeiouy\W\d_]{3,}(?!\w)|[dfgjkqw]l?[jkqw][a-z]|([a-z])\1\1", re.I)
_INNER = re.compile(r"[a-z];[a-z]|^;[a-z]|[a-z];$", re.I)


def _mash(s: str) -> bool:
    """Keyboard mash: the letters and semicolon of one hand position, thrown in any order."""
    tokens = s.split()
    if len(tokens) < 5 or len(s) < 24:
        return False
    odd = sum(1 for t in tokens if _INNER.search(t[:-1] if t.endswith(".") else t)) if ";" in s else 0
    letters = {c for c in s.lower() if c.isalpha()}
    row = sum(1 for c in s.lower() if c in "asdfghjkl;qwertyuiop")
    hard = sum(1 for t in tokens if _HARD.search(t)) if not odd else len(tokens)
    return hard >= 0.4 * len(tokens) and ((odd >= 0.12 * len(tokens) and len(letters) <= 14) or (row >= 0.97 * sum(1 for c in s if not c.isspace()) and len(letters) <= 11 and len(set(tokens)) > 0.6 * len(tokens)))


#: Words that open a stock phrase or stub notice; of the common ones the next word must fit as well.
_FIRST_WORDS = frozenset(
    """this here a some just dummy sample placeholder filler example test testing temporary your the own text heading headline title content caption body paragraph description image picture subtitle
    quote enter insert type add put please replace 1 hier blindtext platzhaltertext beispieltext dies texte faux ceci texto este coming page section site chapter document more details article under work
    information follows nothing no intentionally to tbd tba tbw todo still diese die seite rubrik abschnitt im inhalt dieser noch in cette la rubrique en contenu bientôt rien esta página sección pagina
    próximamente proximamente contenido todavía questa pagina sezione testo questo prossimamente secção seção conteúdo este em deze sectie inhoud tekst binnenkort dit een voorbeeldtekst opvultekst
    dummytekst proeftekst ta strona w wkrótce przykładowy zastępczy denna den sida sidan kommer detta exempeltext platshållartext costruzione""".split()
)


_COMMON = frozenset("this the a some just here to no in la die 1 en your more diese cette esta still this em este questo questa deze dit een ta w den denna detta".split())
_SECOND = frozenset(
    """is a some just dummy sample placeholder filler example test temporary text copy content paragraph sentence own heading headline title caption body description image picture subtitle quote 2
    steht page section site chapter document more details article information be follow come been yet left under seite rubrik abschnitt arbeit vorbereitung rubrique página sección construction
    construcción coming intentionally blank im aufbau tbd to pagina sezione página secção seção costruzione allestimento aanbouw sectie strona budowie här sida sidan är un um em construção obras breve voorbeeldtekst
    opvultekst dummytekst proeftekst en jest przykładowy exempeltext nog è está""".split()
)
_OPENING = re.compile(r"(?:^|[.!?…\n][\"')\]]*)[^\w\n]*(\w+)(?:[ '’-]+(\w+))?")


def _opens_stock(low: str) -> bool:
    return any(a in _FIRST_WORDS and (a not in _COMMON or b in _SECOND) for a, b in _OPENING.findall(low))


def _stock(part: str) -> tuple[str, str] | None:
    """A sentence or line that is a stock phrase of filler or a stub notice."""
    first = part.split(None, 1)[0].lower().strip("([\"'*_-.:!…") if part.strip() else ""
    if first.partition("-")[0] not in _FIRST_WORDS and first not in _FIRST_WORDS:
        return None
    if _FILLER.match(part):
        return "filler", part
    if _STUB.match(part):
        return "stub", part
    return next(((kind, part) for kind, p in _MORE if p.match(part)), None)


def _latin(words: list[str]) -> bool:
    return len(words) >= 4 and sum(w in LATIN for w in words) >= 0.75 * len(words) and len(set(words) & LATIN) >= 3 and not _romance(words)


def find_filler(lines: list[tuple[str, bool]], low: str) -> tuple[str, str] | None:
    """Filler or a stub notice that makes up a sentence or a line."""
    run: list[str] = []
    phrases = _opens_stock(low)
    for line, code in lines:
        s = line.strip()
        if code or not s:
            if s:
                run = []
            continue
        tokens = s.lower().split()
        kinds = set(tokens)
        few = len(kinds) <= 5
        if not few and not phrases and _LONG_LATIN.isdisjoint(kinds) and len(set(s)) > 17:
            run = []
            continue
        s = _BULLET.sub("", s).strip("*_#> \t") or s
        if few:
            words = [w.lower() for w in _WORD.findall(s)]
            if words and len(words) <= 3 and (set(words) <= _DUMMY or len(set(words)) == 1):
                run = run + words if len({*run, *words}) <= 2 else words
                if _repeats(run):
                    return "filler", s
            else:
                run = []
            if _repeats(words):
                return "filler", s[:80]
        else:
            run = []
        if phrases and (got := _stock(s)):
            return got
        latin = not _LONG_LATIN.isdisjoint(kinds)
        if latin and _latin([w.lower() for w in _WORD.findall(s)]) or len(set(s)) <= 17 and _mash(s):
            return "filler", s[:80]
        if not (phrases or latin or few):
            continue
        parts = _SENTENCE.split(s)
        if len(parts) == 1:
            continue
        for part in parts:
            if phrases and (got := _stock(part)):
                return got
            if latin or few:
                w = [x.lower() for x in _WORD.findall(part)]
                if _latin(w) or _repeats(w):
                    return "filler", part[:80]
            if len(set(part)) <= 17 and _mash(part):
                return "filler", part[:80]
    return None


_SHORT_LATIN = frozenset("sit sed do ut et ad in ex ea eu non id est qui vel sunt esse".split())


_LONG_LATIN = LATIN - _SHORT_LATIN - frozenset("do anim nunc magna culpa duis minim nulla velit".split()) | frozenset(("nunc", "magna", "minim"))


def _romance(words: list[str]) -> bool:
    """Only the short words that living languages share with Latin."""
    return all(w in _SHORT_LATIN or w not in LATIN for w in words)


def is_notice_page(text: str, lines: list[tuple[str, bool]]) -> str | None:
    """The notice, if besides it only the site's furniture is left."""
    flat = lines
    if "{" in text and (m := re.fullmatch(r"(?si)(.*?)\{\s*\"(?:status|error|code|message)\"\s*:([^{}]*)\}(.*)", text.strip())):
        values = re.findall(r"\"((?:[^\"\\]|\\.)*)\"", re.sub(r"\"\w+\"\s*:", "", m[2]))
        flat = [(x, False) for x in "\n".join([m[1], *values, m[3]]).split("\n")]
    # Most texts fall with their longest line: one long sentence that is no notice decides.
    longest = max((x for x, _ in flat), key=len)
    if len(longest) > 60 and "<" not in longest and _odd(max(_SENTENCE.split(longest.strip()), key=len)) > ODD_WORDS and not _furniture(longest.strip(), True):
        return None
    if any(code for _, code in flat):
        return None
    menu = _menu_lines([x.strip() for x, _ in flat])
    parts: list[str] = []
    in_list = False
    for k, (line, _) in enumerate(flat):
        s = line.strip()
        if not s or k in menu:
            continue
        pieces = [s]
        if "<" in s and _STRUCTURE.search(s):
            pieces = [html.unescape(_TAG.sub("", x)).strip() for x in _SPLIT_TAGS.split(s)]
        for s in pieces:
            if not s or _SERVER.fullmatch(s):
                continue
            if _furniture(s, in_list):
                in_list = in_list or bool(_LIST_HEAD.match(s))
                continue
            in_list = False
            parts += _SENTENCE.split(s)
    parts = [_RAY.sub("", x.strip()) for x in parts]
    notice, odd, seen = None, 0, 0
    for part in sorted(parts, key=len, reverse=True):
        if not part or not _WORD.search(part) and not re.search(r"\d{3}", part):
            continue
        n = _odd(part)
        if n:
            odd += n
            if n > ODD_WORDS:
                return None
        else:
            seen += len(_WORD.findall(part)) or 1
            if not _AFTER_NOTICE.match(part):
                notice = notice or part
    return notice if notice and odd <= seen // 3 else None


_SPLIT_TAGS = re.compile(r"</?(?:html|head|body|title|noscript|h[1-6]|p|hr|br|center|div|li|ul)\b[^<>]*>", re.I)
_SERVER = re.compile(r"[a-z][\w\-]*/\d[\w.]*(?: \([^()]*\))?(?: (?:server )?at \S+(?: port \d+)?)?|nginx|apache", re.I)
_RAY = re.compile(r"\s*\((?:ray|ref|id|request)[ :]*[\w\-]+\)$", re.I)


def _odd(part: str) -> int:
    """Words of a sentence that is neither a notice nor what usually follows one, else 0."""
    if _AFTER_NOTICE.match(part):
        return 0
    m = _NOTICE.search(part)
    if m:
        # Of a long sentence, words of the web must make up much of what the notice does not match.
        rest = [w for w in _WORD.findall((part[: m.start()] + " " + part[m.end() :]).lower()) if len(w) > 3]
        if len(rest) <= 12 or sum(w in _WEB for w in rest) >= 0.3 * len(rest):
            return 0
    return len(_WORD.findall(part)) or 1


#: Words of a page's own sentence, beyond which a sentence that is no notice makes it content.
ODD_WORDS = 4
#: Words that notices of sites are made of.
_WEB = frozenset(
    """access account address administrator again allow allowed available blocked browser cache click contact contents content continue cookies device disabled display displayed document down enable
    enabled error features file found function functionality hosting internet javascript later link load loaded login maintenance message moved network notice online page pages password permission please
    problem provider refresh reload request requested required requires script scripting scripts security server service session settings site support supported temporarily traffic turn unavailable
    update upgrade user verify version view viewing visit visitor website webmaster wrong without your you""".split()
)


def _menu_lines(lines: list[str]) -> set[int]:
    """Places of lines in runs of three or more that are short, of few words and without a stop."""
    out, run = set(), []
    for k, s in enumerate([*lines, "."]):
        if not s and run:
            continue
        if s and len(s.split()) <= 3 and not re.search(r"[.!?:;,<>{}\d]", s) and not _NOTICE.search(s):
            run.append(k)
            continue
        if len(run) >= 3:
            out.update(run)
        run = []
    return out


def _furniture(s: str, in_list: bool) -> bool:
    """A menu entry, link bar, copyright line or entry of a thread list."""
    if _CHROME.match(s.strip(" .:»›>|")):
        return True
    if re.match(r"^(?:©|\(c\)|copyright).{0,60}$", s, re.I):
        return True
    parts = [p for p in re.split(r"\s*[|·•»/]\s*|\s{2,}", s) if p]
    if len(parts) > 1 and (all(_CHROME.match(p.strip()) for p in parts) or len(parts) > 2 and all(len(p.split()) <= 3 and not re.search(r"[.!?:;,\d]", p) for p in parts)):
        return True
    if _BULLET.match(s):
        body = _BULLET.sub("", s)
        return not re.search(r"[.!;]$", body) and len(body.split()) <= 14
    return bool(_LIST_HEAD.match(s)) and len(s.split()) <= 4


def residue_of(text: str | None) -> tuple[str, str] | None:
    """Kind (placeholder, filler, stub, notice) and evidence, or None. Null and blank are no case."""
    if not text or not text.strip():
        return None
    lines = visible_lines(text)
    low = text.lower()
    got = find_placeholder(lines) if _may_hold_placeholder(text, low) else None
    if got:
        return "placeholder", got
    found = find_filler(lines, low)
    if found:
        return found
    note = is_notice_page(text, lines)
    return ("notice", note) if note else None


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("evidence", pa.string())])


def residue(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``doc_id, kind, evidence`` of the documents to exclude; rows without an id are skipped."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = []
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                got = residue_of(text)
                if got:
                    rows.append((doc, got[0], got[1][:200]))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    src = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, kind string, evidence string")


def without_residue(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents that are left."""
    return docs.join(residue(docs, id_col, text_col).select(F.col("doc_id").alias(id_col)), id_col, "left_anti")
