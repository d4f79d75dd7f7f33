"""Template residue, filler, error pages and script notices in place of content.

A text is cut into messages (lines and sentences) after quoted passages, inline code and fenced code are taken out, so
that texts which quote or discuss such things keep nothing of them. In every message numbers, ids, dates and addresses are
masked, and the exact hash of what is left groups equal messages across all documents and sources. Messages that
documents of WIDE_SOURCES sources or more hold are classified: by phrases, and by words of pages beside words of trouble,
which also catch pages that no phrase lists. A document is a case when widely recurring messages of one kind make up
most of it.

Beside that, dummy words (which recur as words, not as messages) make filler; slots left unfilled in running text make a
placeholder case whatever else a text holds; and a page whose messages are not (yet) held widely is a case only if each
of its messages is one by phrases.

Messages that name code (identifiers, paths with a suffix) are content: no page for readers does.

Defined cases: null, empty and blank texts and texts without any message are no case; null ids are left out; ties
between kinds go to the first of KINDS; repeated documents are cases each; texts of any length are read whole; columns
beyond doc_id, text and source are ignored; a null source counts as one source; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.bitmap import rows_with
from skein.runtime import cut, skew_lookup

KINDS = ("placeholder", "filler", "error_page", "script_notice")
#: A message recurs widely when documents of at least so many sources hold it.
WIDE_SOURCES = 3
#: Lines of menus and the like, which don't count as content, are no longer than this; longer ones count as content.
LONGEST_MENU = 600
#: Share of a text's characters that messages of one kind must make up.
MOST = 0.6
#: Up to so many classified messages are broadcast (some 30 MB at most); beyond, messages meet them by a shuffle.
FEW = 500_000

# --- fixed values: phrases and forms in the four languages of the corpus ---
_CODE = r"(?s)```.*?(?:```|\z)|`[^`\n]*`"
_QUOTED = r'"[^"\n]{1,200}"|“[^”\n]{1,200}”|„[^”“\n]{1,200}[”“]|«[^»\n]{1,200}»'
_TAG = r"(?s)<!--.*?-->|</?(?i:html|head|title|body|h[1-6]|hr|br|p|div|span|noscript|meta|script|a|center|img|pre|ul|ol|li|table|tr|td|style|link)\b[^<>\n]*>"
_NAMES_CODE = r"\b[a-z][a-z0-9]*+(?:[A-Z][a-z0-9]++){1,}+\b|\b[A-Z][a-z0-9]++(?:[A-Z][a-z0-9]++){2,}+\b|\b[a-z]++-[a-z]++-[a-z]++\b|\b\w++\(.*\)"
_PATH_OR_NAME = r"(?<![\w.-])[\w.-]++/[\w.-]+\.[a-z]{1,5}\b|\b[^\W_]++_\w"
_SLOTS_STRONG = (
    r"\{\{\s*[\w.\- ]+?\s*\}\}|%\([\w ]+\)[sd]|\[(?i:insert|your|enter|add|fill in|todo|tbd|wstaw|wpisz|ihr|hier|su|inserte)\b[^\]\n]{0,40}\]|<<\s*[\w ]+\s*>>"
    r"|<%=?[^%\n]{1,40}%>|@@\w+@@|«[A-Za-z]\w*_\w+»|\$\{\s*[\w.\- ]+\s*\}"
)
_SLOTS_WEAK = r"\$[A-Za-z]\w*\$|<[A-Za-z]\w*>|(?<!\w)__[A-Za-z]\w*?__(?!\w)|(?<!\w)#[A-Za-z]\w*#|«[A-Za-z]\w*»|(?<!\w)%[A-Za-z]\w*%|(?<![{$])\{[A-Za-z]\w*\}(?!\})|\[[A-Za-z]\w*\]"
_LAST_SLOT, _NOT_ROLE = r"\[[A-Za-z]\w*\]", r"(?!\[(?:user|assistant|system|agent|x)\])"
_ROLE_MARK = r"(?im)^\s*\[(?:user|assistant|system|agent)\]|^\s*[-*]?\s*\[[ x]\]"
_BOILER = r"(?i)^(?:[\w .&-]{1,20}(?:\s*\|\s*[\w .&-]{1,20})+|©.*|copyright .*|[\w-]{2,25}:\s*\S{0,24}|\(?[0-9a-f]{8,}\)?|[#\s>*-]*\p{L}+|\W*)$"
_STRONG = {
    "filler": (
        r"(?i)\b(?:dummy text|placeholder text|filler text|sample (?:paragraph|text)|your text (?:goes )?here|(?:content|text|more) coming soon|insert (?:summary|text|title|content|description|name)\b"
        r"|tekst zastępczy|wpisz swój tekst|treść wkrótce|akapit do podmiany|przykładowy (?:akapit|tekst)|blindtext|platzhaltertext|hier steht ihr text|inhalt folgt|beispielabsatz|beispieltext"
        r"|texto de (?:relleno|ejemplo)|aquí va su texto|contenido disponible pronto|párrafo de muestra|lorem ipsum)"
    ),
    "error_page": (
        r"(?i)^(?:error:?\s*)?(?:http/\d(?:\.\d)?\s+)?[45]\d\d\b[\s:.-]*(?:\p{L}[\p{L} -]{0,40})?\.?$|^(?:(?:page )?not found|forbidden|bad gateway|bad request|unauthorized|service (?:temporarily )?unavailable|internal server error|too many requests|gateway time-?out|request time-?out)\.?$"
        r"|^\s*\{\s*\"?(?:error|errors|message|status|code)\b.*|\baccess (?:is )?denied\b|\bno (?:such )?page\b|page (?:you requested )?(?:was|could) not|\bwent wrong\b|\b(?:unexpected|internal|server) error\b|\berror (?:has )?occurred\b|\btimed out\b|\bdown for (?:scheduled )?maintenance\b"
        r"|\bno longer exists\b|\blink is broken\b|^too many requests\b|\bis (?:currently |temporarily )?unavailable\.?$"
        r"|\bnie znaleziono\b|\bbrak dostępu\b|\bwystąpił (?:\w+ )?błąd\b|\bprzekroczono czas\b|\bprzerwa techniczna\b|\bzbyt wiele (?:żądań|zapytań)\b|\bstrona nie istnieje\b"
        r"|\bnicht gefunden\b|\bzugriff\b.*\bverweigert\b|\binterner (?:server)?fehler\b|\bzeitüberschreitung\b|\bwartungsarbeiten\b|\bzu viele anfragen\b|\bist ein fehler aufgetreten\b"
        r"|\bno se encontró\b|\bacceso denegado\b|\bse produjo un error\b|\ben mantenimiento\b|\btardó demasiado\b|\bdemasiadas solicitudes\b|\bno disponible\b"
    ),
    "script_notice": (
        r"(?i)^(?=.*\b(?:java ?script|scripts?|scripting|skrypt\w*|skripte?\w*|client-side code|cookies|ciasteczk\w*|human|przeglądark\w*|browser\w*|navegador)\b)"
        r".*(?:\benable\b|\bdisabled\b|\bturn(?:ed)? (?:\w+ )?o(?:n|ff)\b|\bswitch(?:ed)? o(?:n|ff)\b|\brequires?\b|\bneeds?\b|\ballow\b|\bdoes not work\b|\bnot supported\b|\bwithout (?:java ?)?script\w*\b.*\bnot\b|\bverifying\b|\bchecking your browser\b"
        r"|\bwłącz\b|\bwymaga\b|\bblokuje\b|\bzezwól\b|\bpotrzebn\w+\b|\bsprawdzamy\b|\baktivier\w*|\bbenötigt\b|\bblockiert\b|\bzulassen\b|\bohne java ?script\b.*\bnicht\b|\bprüfen\b|\bactiv(?:e|ar)\b|\bnecesita\b|\bbloquea\b|\bpermita\b|\bno funciona\b|\bcomprobando\b)"
    ),
}
_WEAK = {
    "error_page": (
        r"(?i)\b(?:try (?:again|once more)|reload (?:the|this) page|come back later|our team has been|return to the|back to the (?:start|home)|wait a (?:minute|moment)|may not open|error id|request id)\b|^(?:case|trace|incident|ref(?:erence)?)\b[\s:#]*\W*"
        r"|\bspróbuj ponownie\b|\bwróć na\b|\bnumer błędu\b|\bzapraszamy później\b|\bversuchen sie es\b|\bkennung\b|\bzurück zur\b|\bbald zurück\b|\binténtelo\b|^código\b|\bvolver al?\b|\bvolvemos pronto\b"
    ),
    "script_notice": r"(?i)\b(?:turn (?:it|them) on|reload the page|your browser)\b",
}
#: Words of pages beside words of trouble, and words of scripts beside demands: for messages that recur widely.
_PAGE_WORDS = r"(?i)\b(?:pages?|(?:web)?site|server|request|url|links?|address|resource|service|connection|session|stron[ay]|adres|serwer\w*|żądani\w+|usług\w*|seite|anfrage|verbindung|dienst|página|sitio|servidor|solicitud|enlace|servicio)\b"
_TROUBLE_WORDS = r"(?i)\b(?:can(?:'t|’t|not)|could(?:n't|n’t| not)|not|no longer|unable|fail(?:ed|ure)|error|denied|forbidden|expired|unavailable|missing|blocked|broken|wrong|oops|sorry|invalid|refused|nie|błąd|błędu|wygasł\w*|nicht|fehler|abgelaufen|gesperrt|no|error|caducad\w+|bloquead\w+)\b"
_SCRIPT_WORDS = r"(?i)\b(?:java ?script|cookies?|captcha|robots?|bot|browser|ciasteczk\w*|przeglądark\w*|navegador)\b"
_DEMAND_WORDS = r"(?i)\b(?:enable|allow|turn|switch|require[sd]?|needs?|must|verify|checking|disabled|włącz|wymaga|sprawdzamy|aktivier\w*|benötigt|prüfen|active|habilite|necesita|comprobando)\b"
#: Such a message has no more words than this.
_PAGE_LENGTH = 25
_MASH_WORDS = "foo bar baz qux quux asdf qwer qwerty zxcv hjkl blah bla xxx xxxx yyy zzz test abc".split()
_HOME_ROW = "[asdfghjklqwe]"
_OUTLINE = r"(?i)^[#\s]*(?:(?:section|heading|title|item|chapter|paragraph|subheading|slide|abschnitt|überschrift|titel|sekcja|nagłówek|punkt|sección|título|elemento)\s+\d+|(?:some|paragraph|body|sample|description)(?:\s+(?:text|copy))?|description|text here|beschreibung|opis|descripción|fließtext|treść akapitu|texto del párrafo)\.?$"
#: Words of the classical dummy text.
_LATIN = (
    "a ac accumsan ad adipiscing aenean aliqua aliquam aliquet aliquip amet anim ante aptent arcu at auctor augue aute bibendum blandit cillum commodo condimentum congue consectetur consequat convallis cras "
    "culpa cupidatat curabitur cursus dapibus deserunt diam dictum dignissim do dolor dolore donec duis ea egestas eget eiusmod eleifend elementum elit enim erat eros esse est et etiam eu euismod ex excepteur "
    "exercitation facilisis fames faucibus felis fermentum feugiat fringilla fugiat fusce gravida habitant hendrerit iaculis id imperdiet in incididunt integer interdum ipsum irure justo labore laboris laborum lacinia lacus "
    "laoreet lectus leo libero ligula lobortis lorem luctus maecenas magna malesuada massa mattis mauris metus mi minim mollis mollit morbi nam nec neque netus nibh nisi nisl non nostrud nulla nullam nunc occaecat "
    "odio officia orci ornare pariatur pellentesque pharetra placerat porta porttitor praesent pretium proident pulvinar purus quam quis reprehenderit rhoncus risus rutrum sagittis sapien sed sem semper senectus sint sit sodales "
    "sollicitudin sunt suscipit tellus tempor tempus tincidunt tortor tristique turpis ullamco ultrices ultricies urna ut varius vehicula vel velit veniam venenatis vestibulum vitae vivamus viverra volutpat voluptate vulputate"
)
# --- end of fixed values ---


def _replaced(c: Column, sign: str, pattern: str, by: str) -> Column:
    """regexp_replace where `sign`, which every match holds, occurs at all."""
    return F.when(c.contains(sign) if len(sign) == 1 else c.rlike(sign), F.regexp_replace(c, pattern, by)).otherwise(c)


def content(text: Column) -> Column:
    """Text without code and, for slots, with quotations kept."""
    return _replaced(text, "`", _CODE, " ")


def messages(text: Column) -> Column:
    """Lines and sentences without tags and quotations."""
    plain = F.transform(F.array(text), lambda t: F.regexp_replace(_replaced(content(t), "<", _TAG, "\n"), r"^\s*([\[{])", "$1"))
    # JSON bodies keep their quotes: they are the message
    plain = F.transform(plain, lambda t: F.when(t.rlike(r"^\s*[{\[]"), t).otherwise(_replaced(t, '["“„«]', _QUOTED, " § ")))
    return F.filter(F.transform(F.split(plain[0], r"(?<=[.!?…])\s+|[\r\n]+"), lambda u: F.trim(F.regexp_replace(u, r"(?U)^[\s#>*-]+|\s+$", ""))), lambda u: u != "")


def masked(low: Column) -> Column:
    """Lower-case message with addresses, numbers and the rest of their ids, dates and versions as signs."""
    addresses = lambda m: F.regexp_replace(m, r"https?://\S+|(?<![\w.+-])[\w.+-]++@[\w.-]+|(?<!\w)/[\w./-]+", "§")
    numbers = lambda m: F.regexp_replace(m, r"\b[a-f]{0,12}+\d[\da-f:.tz-]*", "§")
    # whole chains as branches: inside lambdas a branch computes its input again, and the bare message costs nothing
    digits, signs = low.rlike(r"\d"), low.rlike("[/@]")
    m = F.when(signs & digits, numbers(addresses(low))).when(digits, numbers(low)).when(signs, addresses(low)).otherwise(low)
    return F.regexp_replace(m, r" *[\s\u200b\p{Z}&&[^ ]][\s\u200b\p{Z}]*| {2,}", " ")


def _filler(low: Column) -> Column:
    """Whether dummy words, or words of the middle row of keys, make up a lower-case message."""
    few = F.size(F.filter(F.split(low, r"[ .,;:!?]"), lambda x: x.isin(*_LATIN.split(), *_MASH_WORDS)))
    w = F.split(low, r"[^\p{L}]+")
    n = F.size(F.filter(w, lambda x: x != ""))
    latin = F.size(F.filter(w, lambda x: x.isin(*_LATIN.split())))
    mash = F.size(F.filter(w, lambda x: x.isin(*_MASH_WORDS)))
    home = F.size(F.filter(w, lambda x: x.rlike(f"^{_HOME_ROW}+$")))
    words = F.when(few >= 3, ((n >= 4) & (latin * 10 >= n * 7)) | ((n >= 3) & (mash * 10 >= n * 8))).otherwise(F.lit(False))
    # nine tenths of six words or more leave five in a row
    keys = F.when(low.rlike(rf"(?:\b{_HOME_ROW}++\P{{L}}++){{4}}{_HOME_ROW}++\b"), (n >= 6) & (home * 10 >= n * 9)).otherwise(F.lit(False))
    return words | keys


def classify(message: Column, wide: bool) -> Column:
    """Struct (kind, weak): what a message is by the rules; null kind for content. wide: it recurs widely."""
    json_error = message.rlike(r'(?i)^\s*\{\s*"?(?:error|errors|message|status)')
    code = message.rlike(_PATH_OR_NAME) | message.rlike(_NAMES_CODE) & ~message.rlike("(?i)javascript")
    kind = F.when(message.rlike(_OUTLINE) | message.rlike(_STRONG["filler"]), F.lit("filler")).when(message.rlike(_STRONG["script_notice"]), F.lit("script_notice")).when(message.rlike(_STRONG["error_page"]), F.lit("error_page"))
    weak = F.when(message.rlike(_WEAK["error_page"]), F.lit("error_page")).when(message.rlike(_WEAK["script_notice"]), F.lit("script_notice"))
    if wide:
        short = F.size(F.split(message, r"\s+")) <= _PAGE_LENGTH
        words = F.when(short & message.rlike(_SCRIPT_WORDS) & message.rlike(_DEMAND_WORDS), F.lit("script_notice")).when(short & message.rlike(_PAGE_WORDS) & message.rlike(_TROUBLE_WORDS), F.lit("error_page"))
        kind = F.coalesce(kind, F.when(weak.isNull(), words))
    both = F.struct(F.coalesce(kind, weak).alias("kind"), (kind.isNull() & weak.isNotNull()).alias("weak"))
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(False).alias("weak"))
    return F.when(json_error, F.struct(F.lit("error_page").alias("kind"), F.lit(False).alias("weak"))).when(message.contains("§") | code, none).otherwise(both)


def slots(text: Column) -> Column:
    """Struct (strong, weak): numbers of unfilled slots in running text; null where there is none at all."""
    first = r"(?=[{%\[<@«$_#])"
    count = lambda c, rx: F.size(F.regexp_extract_all(c, F.lit(f"{first}(?:{rx})"), F.lit(0)))
    clean = F.transform(F.array(F.regexp_replace(content(text), _ROLE_MARK, "")), lambda t: F.regexp_replace(t, _TAG, " "))
    both = F.transform(clean, lambda t: F.struct(count(t, _SLOTS_STRONG).alias("strong"), count(F.regexp_replace(t, _SLOTS_STRONG, " "), _SLOTS_WEAK).alias("weak")))[0]
    # every slot stands in the text as it is, too
    return F.when(text.rlike(f"{first}(?:{_SLOTS_STRONG}|{_SLOTS_WEAK.replace(_LAST_SLOT, _NOT_ROLE + _LAST_SLOT)})"), both)


def _scanned(documents: DataFrame) -> DataFrame:
    """One pass over all texts: doc_id, source, filled and units (key, len, menu, kind, weak) of the documents with messages.

    key is the 64-bit hash of the masked message. kind is set for filler words and, in texts that begin like a page, by
    phrases.
    """
    d = documents.where("doc_id is not null and text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    d = d.select("doc_id", "source", slots(F.col("text")).alias("s"), messages(F.col("text")).alias("ms"))
    d = d.select("doc_id", "source", F.coalesce((F.col("s.strong") >= 1) | (F.col("s.strong") + F.col("s.weak") >= 2), F.lit(False)).alias("filled"), "ms")
    menu = lambda u: F.when(F.length(u) <= LONGEST_MENU, u.rlike(_BOILER)).otherwise(F.lit(False))
    d = d.withColumn("ms", F.transform("ms", lambda u: F.struct(u.alias("m"), F.lower(u).alias("low"), menu(u).alias("menu"))))
    opening = F.coalesce(F.get(F.filter("ms", lambda u: ~u["menu"]), F.lit(0)), F.get("ms", F.lit(0)))["m"]
    d = d.withColumn("page", F.coalesce(classify(opening, False)["kind"].isNotNull(), F.lit(False)))
    unit = lambda u, c: F.struct(F.xxhash64(masked(u["low"])).alias("key"), F.length(u["m"]).alias("len"), u["menu"].alias("menu"), c["kind"].alias("kind"), c["weak"].alias("weak"))
    by_words = lambda u: F.struct(F.when(_filler(u["low"]) & ~u["m"].contains("§"), F.lit("filler")).alias("kind"), F.lit(False).alias("weak"))
    by_phrases = lambda u: F.struct(F.coalesce(by_words(u)["kind"], classify(u["m"], False)["kind"]).alias("kind"), (by_words(u)["kind"].isNull() & classify(u["m"], False)["weak"]).alias("weak"))
    units = F.when(F.col("page"), F.transform("ms", lambda u: unit(u, by_phrases(u)))).otherwise(F.transform("ms", lambda u: unit(u, by_words(u))))
    return cut(d.select("doc_id", "source", "filled", "page", units.alias("units")))


def _wide(scanned: DataFrame, documents: DataFrame) -> DataFrame:
    """key, kind, weak, docs, sources, message of the widely recurring messages that are none of content."""
    keys = scanned.select("doc_id", "source", F.explode(F.array_distinct(F.transform("units", lambda u: u["key"]))).alias("key"))
    by_source = keys.groupBy("key", "source").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("doc_id"))
    wide = by_source.groupBy("key").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("sources"), F.min("doc_id").alias("doc_id")).where(F.col("sources") >= WIDE_SOURCES)
    wide = cut(wide)
    # the texts of one document for each of them are cut again, to read the message itself
    texts = rows_with(documents.select("doc_id", "text"), wide.select("doc_id").distinct(), "doc_id").select("doc_id", F.explode(messages(F.col("text"))).alias("message"))
    named = wide.join(texts.select("doc_id", F.xxhash64(masked(F.lower("message"))).alias("key"), "message"), ["doc_id", "key"]).groupBy("key", "docs", "sources").agg(F.min("message").alias("message"))
    c = classify(F.col("message"), True)
    return cut(named.select("key", c["kind"].alias("kind"), c["weak"].alias("weak"), "docs", "sources", "message").where("kind is not null"))


def recurring(documents: DataFrame) -> DataFrame:
    """message, kind, docs, sources of each widely recurring message that is no content."""
    return _wide(_scanned(documents), documents).select(masked(F.lower("message")).alias("message"), "kind", "docs", "sources")


def found(documents: DataFrame) -> DataFrame:
    scanned = _scanned(documents)
    wide = _wide(scanned, documents)
    units = scanned.select("doc_id", "page", F.explode("units").alias("u")).select("doc_id", "page", "u.*")
    known = wide.select("key", F.col("kind").alias("wide_kind"), F.col("weak").alias("wide_weak"))
    if wide.count() <= FEW:
        marked = units.join(F.broadcast(known), "key", "left")
    else:
        marked = skew_lookup(units, known, "key")
    # what recurs widely goes by its class, all else by words or, in texts that begin like a page, by phrases
    marked = marked.select("doc_id", "len", "menu", F.coalesce("wide_kind", "kind").alias("kind"), F.coalesce("wide_weak", "weak").alias("weak"), F.col("wide_kind").isNotNull().alias("wide"))
    size = lambda cond: F.sum(F.when(cond, F.col("len")).otherwise(F.lit(0)))
    of = lambda k, cond: size((F.col("kind") == k) & cond)
    pages = KINDS[1:]
    sure = [of(k, ~F.col("weak")).alias(f"sure_{k}") for k in pages] + [of(k, F.col("weak") & F.col("wide")).alias(f"weak_{k}") for k in pages]
    doc = marked.groupBy("doc_id").agg(
        size(~F.col("menu") | F.col("kind").isNotNull()).alias("total"), size(F.col("kind").isNotNull()).alias("all"), F.coalesce(F.max(~F.col("weak") & (F.col("wide") | (F.col("kind") == "filler"))), F.lit(False)).alias("by_wide"), *sure
    )
    best = F.array_max(F.array(*[F.struct(F.col(f"sure_{k}").alias("sure"), F.col(f"weak_{k}").alias("weak"), F.lit(-i).alias("o"), F.lit(k).alias("kind")) for i, k in enumerate(pages)]))
    doc = doc.withColumn("best", best)
    lone = F.when(F.col("by_wide"), F.col("all") >= F.col("total") * MOST).otherwise(F.col("all") >= F.col("total"))
    most = F.when(F.col("best.sure") > 0, lone).otherwise((F.col("best.weak") > 0) & (F.col("best.weak") >= F.col("total")))
    filled = scanned.where("filled").select("doc_id", F.lit("placeholder").alias("kind"))
    both = filled.unionByName(doc.where(most).select("doc_id", F.col("best.kind").alias("kind")))
    return both.groupBy("doc_id").agg(F.max(F.when(F.col("kind") == "placeholder", F.col("kind"))).alias("p"), F.max("kind").alias("k")).select("doc_id", F.coalesce("p", "k").alias("kind"))


def kept(documents: DataFrame) -> DataFrame:
    """doc_id of the documents left when the cases are excluded."""
    return documents.where("doc_id is not null").select("doc_id").join(found(documents), "doc_id", "left_anti")
