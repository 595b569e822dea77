"""The SQL that rendered works are held against, written for DuckDB."""

from __future__ import annotations

from citeweave.tables import WORKS_SQL


def j(by: str, *parts: str) -> str:
    """The parts that are not empty, with ``by`` between."""
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x <> ''), '{by}')"


def on(condition: str, text: str, other: str = "''") -> str:
    return f"CASE WHEN {condition} THEN {text} ELSE {other} END"


def dot(text: str) -> str:
    return f"""regexp_replace({text}, '([^.?!”’"'']|[^.?!”’"''][”’"''])$', '\\0.')"""


def pre(lead: str, name: str, end: str = "") -> str:
    """``lead`` and the column, if it is not empty."""
    return on(f"{name} <> ''", f"'{lead}' || {name} || '{end}'")


def listed(names: str, word: str = " and ", oxford: str = ",", pair: str = "") -> str:
    n = f"len({names})"
    return f"CASE WHEN {n} = 0 THEN '' WHEN {n} = 1 THEN {names}[1] WHEN {n} = 2 THEN {names}[1] || '{pair}{word}' || {names}[2] ELSE array_to_string({names}[:{n} - 1], ', ') || '{oxford}{word}' || {names}[{n}] END"


_FORMS = """list_transform({0}, lambda p: {{'fam': p.family, 'lit': p.given = '', 'given': p.given,
    'ini': array_to_string(list_transform(string_split(p.given, ' '), lambda g: array_to_string(list_transform(string_split(g, '-'), lambda q: upper(q[1]) || '.'), '-')), ' ')}}) AS {1}"""
_KINDS = "CASE type WHEN 'journal-article' THEN 'journal' WHEN 'book-chapter' THEN 'chapter' WHEN 'dissertation' THEN 'thesis' WHEN 'posted-content' THEN 'preprint' WHEN 'proceedings-article' THEN 'proceedings' ELSE type END"
_MONTHS = {
    "full": "January February March April May June July August September October November December", "mla": "Jan. Feb. Mar. Apr. May June July Aug. Sept. Oct. Nov. Dec.",
    "ieee": "Jan. Feb. Mar. Apr. May Jun. Jul. Aug. Sep. Oct. Nov. Dec.", "nlm": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec",
}


def month(form: str) -> str:
    return f"CASE WHEN month > 0 THEN string_split('{_MONTHS[form]}', ' ')[month] ELSE '' END"


_T = {
    "li": "CASE WHEN p.lit THEN p.fam ELSE p.fam || ', ' || p.ini END", "il": "CASE WHEN p.lit THEN p.fam ELSE p.ini || ' ' || p.fam END",
    "lf": "CASE WHEN p.lit THEN p.fam ELSE p.fam || ', ' || p.given END", "fl": "CASE WHEN p.lit THEN p.fam ELSE p.given || ' ' || p.fam END",
    "lt": "CASE WHEN p.lit THEN p.fam ELSE p.fam || ', ' || replace(p.ini, ' ', '') END", "tl": "CASE WHEN p.lit THEN p.fam ELSE replace(p.ini, ' ', '') || ' ' || p.fam END",
    "nl": "CASE WHEN p.lit THEN p.fam ELSE p.fam || ' ' || translate(p.ini, '. ', '') END", "fm": "p.fam", "tg": "CASE WHEN p.lit THEN p.fam || ',' ELSE p.fam || ', ' || p.given END",
    "bn": "CASE WHEN p.lit THEN '{' || p.fam || '}' ELSE p.fam || ', ' || p.given END",
}
_LISTS = ", ".join(f"list_transform({who}, lambda p: {form}) AS {who}_{name}" for who in ("a", "e") for name, form in _T.items())
MADE = f"""WITH {WORKS_SQL},
h AS (SELECT id, title, authors, editors, coalesce(year::VARCHAR, '') AS year, month, coalesce(volume::VARCHAR, '') AS volume, coalesce(issue::VARCHAR, '') AS issue,
  CASE WHEN pages IS NULL THEN '' WHEN split_part(pages, '-', 1) = split_part(pages, '-', 2) THEN split_part(pages, '-', 1) ELSE pages END AS pages, coalesce(edition, '') AS edition, container,
  coalesce(publisher, '') AS publisher, coalesce(place, '') AS place, coalesce(doi, '') AS doi, type FROM works),
f AS (SELECT *, {_KINDS} AS kind, {_FORMS.format("authors", "a")}, {_FORMS.format("editors", "e")}, replace(pages, '-', '–') AS dashed, (CASE WHEN contains(pages, '-') THEN 'pp. ' ELSE 'p. ' END) || replace(pages, '-', '–') AS pp_,
  split_part(pages, '-', 1) AS p1, split_part(pages, '-', 2) AS p2, CASE WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE '' END AS link,
  CASE WHEN edition = '' THEN '' WHEN edition::INT IN (11, 12) THEN edition || 'th' WHEN edition::INT % 10 = 1 THEN edition || 'st' WHEN edition::INT % 10 = 2 THEN edition || 'nd' WHEN edition::INT % 10 = 3 THEN edition || 'rd'
    ELSE edition || 'th' END AS nth FROM h),
g AS (SELECT *, {_LISTS}, CASE WHEN nth = '' THEN '' ELSE nth || ' ed.' END AS ed, {j(": ", "place", "publisher")} AS imprint, CASE WHEN pages = '' THEN '' ELSE pp_ END AS pp,
  CASE WHEN p2 = '' THEN p1 WHEN len(p1) <> len(p2) THEN p1 || '-' || p2 ELSE p1 || '-' || p2[1 + len(list_filter(range(1, len(p1)), lambda i: p1[:i] = p2[:i])):] END AS nlm FROM f)"""


def style(head: str, **kinds: str) -> str:
    other = kinds.pop("other")
    cases = " ".join(f"WHEN kind IN ({', '.join(repr(k) for k in names.split('_'))}) THEN {text}" for names, text in kinds.items())
    return f"{MADE}, m AS (SELECT *, {head} AS who FROM g) SELECT id, CASE {cases} ELSE {other} END AS text FROM m"


def _eds(one: str, more: str) -> str:
    return f"CASE WHEN len(e) > 1 THEN '{more}' ELSE '{one}' END"


def _either(authors: str, editors: str) -> str:
    return f"CASE WHEN len(a) > 0 THEN {authors} WHEN len(e) > 0 THEN {editors} ELSE '' END"


_APA_LIST = lambda p: f"CASE WHEN len({p}) = 1 THEN {p}_li[1] ELSE array_to_string({p}_li[:len({p}) - 1], ', ') || ', & ' || {p}_li[len({p})] END"
_APA_YEAR = on("year <> ''", "'(' || year || ').'", "'(n.d.).'")


def _apa(title: str, tail: str) -> str:
    return j(" ", on("who <> ''", j(" ", dot("who"), _APA_YEAR, title), j(" ", title, _APA_YEAR)), tail, "link")


_NUMBERS = on("volume <> '' OR issue <> ''", "volume || " + on("issue <> ''", "'(' || issue || ')'"))
_IN_PAREN = j(", ", "ed", "pp")
_APA_PART = j(" ", f"'In ' || {on('len(e) > 0', listed('e_il', ' & ') + ' || ' + _eds(' (Ed.), ', ' (Eds.), '))} || container || " + on(f"{_IN_PAREN} <> ''", f"' (' || {_IN_PAREN} || ')'") + " || '.'", dot("publisher"))
_APA_BOOK = on("ed <> ''", "title || ' (' || ed || ').'", dot("title"))
_AUTHOR_IS = lambda name: f"len(list_filter(a, lambda p: p.lit AND lower(p.fam) = lower({name}))) > 0"
_APA_THESIS = f"title || ' [' || {j(', ', repr('Doctoral dissertation'), on(chr(112) + 'ublisher <> ' + chr(39) * 2, 'publisher', 'container'))} || '].'"
APA = style(
    _either(_APA_LIST("a"), f"{_APA_LIST('e')} || {_eds(' (Ed.)', ' (Eds.)')}"),
    journal=_apa(dot("title"), f"{j(', ', 'container', _NUMBERS, 'dashed')} || '.'"), chapter_proceedings=_apa(dot("title"), _APA_PART),
    book=_apa(_APA_BOOK, on(_AUTHOR_IS("publisher"), "''", dot("publisher"))),
    thesis=_apa(_APA_THESIS, on("publisher <> '' AND false", "''")), other=_apa(dot("title"), on(_AUTHOR_IS("container"), "''", dot("container"))),
)

_LEAD = lambda p, first, rest: f"CASE WHEN len({p}) > 2 THEN {p}_{first}[1] || ', et al' WHEN len({p}) = 2 THEN {p}_{first}[1] || ', and ' || {p}_{rest}[2] ELSE {p}_{first}[1] END"
_MLA_EDS = on("len(e) > 2", "e_fl[1] || ' et al.'", listed("e_fl", oxford=""))
_MLA_DATE = f"CASE WHEN year = '' THEN '' WHEN kind = 'book' OR month = 0 THEN year ELSE {month('mla')} || ' ' || year END"
_MLA_SHOWN = on("kind <> 'journal' AND publisher <> container", "publisher")
_BY = on("len(e) > 0", f"'edited by ' || {_MLA_EDS}")
_EDITED = on("len(e) > 0 AND len(a) = 0", f"'Edited by ' || {_MLA_EDS}")
_MLA_HELD = lambda by: j(", ", "container", by, pre("vol. ", "volume"), pre("no. ", "issue"), _MLA_SHOWN, _MLA_DATE, "pp", "link")
_QUOTED = f"'“' || {dot('title')} || '”'"
_MLA_BOOK = j(", ", on("len(e) > 0 AND len(a) > 0", f"'Edited by ' || {_MLA_EDS}"), "publisher", _MLA_DATE, "link")
MLA = style(
    f"CASE WHEN len(a) > 0 THEN {_LEAD('a', 'lf', 'fl')} WHEN len(e) > 0 AND kind IN ('book', 'chapter', 'proceedings') THEN ({_LEAD('e', 'lf', 'fl')}) || {_eds(', editor', ', editors')} ELSE '' END",
    book=j(" ", dot("who"), dot("title"), on(f"{_MLA_BOOK} <> ''", f"{_MLA_BOOK} || '.'")), chapter_proceedings=j(" ", dot("who"), _QUOTED, f"{_MLA_HELD(_BY)} || '.'"),
    other=j(" ", dot("who"), _QUOTED, f"{_MLA_HELD(_EDITED)} || '.'"),
)

_INVERTED = lambda p: f"list_concat([{p}_lf[1]], {p}_fl[2:])"
_CHI_LIST = lambda p: f"CASE WHEN len({p}) = 1 THEN {p}_lf[1] ELSE array_to_string(list_concat([{p}_lf[1]], {p}_fl[2:len({p}) - 1]), ', ') || ', and ' || {p}_fl[len({p})] END"
_YEAR = on("year <> ''", "year", "'n.d.'")
_IMPRINT = dot(j(", ", "imprint", _YEAR))
_CHI_END = on("link <> ''", "link || '.'")
_CHI_DATE = on("year <> ''", j(" ", month("full"), "year"), "'n.d.'")
_CHI_JOURNAL = f"{j(', ', j(' ', 'container', 'volume'), pre('no. ', 'issue'))} || ' (' || {_CHI_DATE} || ')' || {pre(': ', 'dashed')}"
_CHI_IN = j(", ", "'In ' || container", on("len(e) > 0", f"'edited by ' || {listed('e_fl')}"), "dashed")
CHICAGO = style(
    _either(_CHI_LIST("a"), f"({_CHI_LIST('e')}) || {_eds(', ed', ', eds')}"),
    journal=j(" ", dot("who"), _QUOTED, dot(_CHI_JOURNAL), _CHI_END), book=j(" ", dot("who"), dot("title"), dot("ed"), _IMPRINT, _CHI_END), chapter_proceedings=j(" ", dot("who"), _QUOTED, dot(_CHI_IN), _IMPRINT, _CHI_END),
    thesis=j(" ", dot("who"), _QUOTED, dot(j(", ", "'PhD diss.'", "publisher", "year")), _CHI_END), other=j(" ", dot("who"), _QUOTED, dot(j(", ", "container", _YEAR)), _CHI_END),
)

_HAR_LIST = lambda p, f: on(f"len({p}) > 3", f"{p}_{f}[1] || ' et al.'", listed(f"{p}_{f}", oxford=""))
_HAR_YEAR = on("year <> ''", "'(' || year || ')'", "'(no date)'")
_HAR_END = pre("Available at: ", "link")
_HAR_EDS = on("len(e) > 0", f"({_HAR_LIST('e', 'tl')}) || {_eds(' (ed.) ', ' (eds) ')}")
_HAR_SHOWN = on("kind <> 'journal' AND publisher <> container", "publisher")
HARVARD = style(
    _either(_HAR_LIST("a", "lt"), f"({_HAR_LIST('e', 'lt')}) || {_eds(' (ed.)', ' (eds)')}"),
    book=j(" ", "who", _HAR_YEAR, on("nth <> ''", "title || ', ' || nth || ' edn.'", dot("title")), dot("imprint"), _HAR_END),
    chapter_proceedings=j(" ", "who", _HAR_YEAR, f"'‘' || title || '’, in ' || {_HAR_EDS} || {dot('container')}", dot(j(", ", "imprint", "pp")), _HAR_END),
    thesis=j(" ", "who", _HAR_YEAR, dot("title"), "'PhD thesis.'", dot("publisher"), _HAR_END), report=j(" ", "who", _HAR_YEAR, dot("title"), dot("imprint"), _HAR_END),
    other=j(" ", "who", _HAR_YEAR, dot(j(", ", "'‘' || title || '’'", "container", _NUMBERS, _HAR_SHOWN, "pp")), _HAR_END),
)

_PERSONS = "list_transform(list_filter(a, lambda p: NOT p.lit), lambda p: " + _T["nl"] + ")"
_VAN_WHO = j("; ", on(f"len({_PERSONS}) > 6", f"array_to_string(({_PERSONS})[:6], ', ') || ', et al'", f"array_to_string({_PERSONS}, ', ')"), "array_to_string(list_transform(list_filter(a, lambda p: p.lit), lambda p: p.fam), ', ')")
_VAN_IMPRINT = f"imprint || {pre('; ', 'year')}"
_VAN_END = pre("doi: ", "doi", ".")
_VAN_EDS = f"array_to_string(e_nl, ', ') || {_eds(', editor', ', editors')}"
_VAN_TAIL = f"regexp_replace({on(chr(121) + 'ear <> ' + chr(39) * 2, j(' ', 'year', month('nlm')))} || {on('volume <> ' + chr(39) * 2, chr(39) + ';' + chr(39) + ' || ' + _NUMBERS, pre(';(', 'issue', ')'))} || {pre(':', 'nlm')}, '^[;:]', '')"
VANCOUVER = style(
    _either(_VAN_WHO, _VAN_EDS),
    journal=j(" ", dot("who"), dot("title"), on(f"{_VAN_TAIL} <> ''", f"{dot('container')} || ' ' || {_VAN_TAIL} || '.'", dot("container")), _VAN_END), book=j(" ", dot("who"), dot("title"), "ed", dot(_VAN_IMPRINT), _VAN_END),
    chapter_proceedings=j(" ", dot("who"), dot("title"), f"'In: ' || {on('len(e) > 0', _VAN_EDS + ' || ' + repr('. '))} || {dot('container')}", "ed", pre("Vol. ", "volume", "."), dot(_VAN_IMPRINT), pre("p. ", "nlm", "."), _VAN_END),
    other=j(" ", dot("who"), dot("title"), dot(j("; ", "container", "year")), _VAN_END),
)

_IEEE_DATE = on("year <> ''", j(" ", month("ieee"), "year"))
_IEEE_EDS = f"({listed('e_il')}) || {_eds(', Ed.', ', Eds.')}"
_IEEE_TAIL = j(", ", "imprint", _IEEE_DATE, "pp", pre("doi: ", "doi"))
_IEEE_HEAD = f"'“' || title || ',” in ' || container || {pre(', vol. ', 'volume')} || {on('len(e) > 0', repr(', ') + ' || ' + _IEEE_EDS + ' || ' + repr(','))}"
_IEEE_BETWEEN = f"CASE WHEN len(e) > 0 THEN {on('ed <> ' + chr(39) * 2, repr(' ') + ' || ed || ' + repr(' '), repr(' '))} WHEN ed <> '' THEN ', ' || ed || ' ' WHEN kind = 'proceedings' THEN ', ' ELSE '. ' END"
_IEEE_REST = j(", ", "container", pre("vol. ", "volume"), pre("no. ", "issue"), "pp", on("kind <> 'journal' AND publisher <> container", "publisher"), _IEEE_DATE, pre("doi: ", "doi"))
_WHO = on("who <> ''", "who || ','")
IEEE = style(
    _either(on("len(a) > 6", "a_il[1] || ' et al.'", listed("a_il")), _IEEE_EDS),
    book=j(" ", _WHO, on("ed <> ''", "title || ', ' || ed", dot("title")), dot(j(", ", j(", ", "imprint", "year"), pre("doi: ", "doi")))),
    chapter_proceedings=j(" ", _WHO, on(f"{_IEEE_TAIL} <> ''", f"{_IEEE_HEAD} || {_IEEE_BETWEEN} || {dot(_IEEE_TAIL)}", dot(_IEEE_HEAD))), other=j(" ", _WHO, dot(f"'“' || title || ',” ' || {_IEEE_REST}")),
)

_ONE_FIRST = lambda p: f"list_concat({p}_lt[:1], {p}_tl[2:])"
_CAR_YEAR = on("year <> ''", "year || '.'", "'n.d.'")
_CAR_EDS = on("len(e) > 0", f"' (' || {listed('e_tl')} || {_eds(', ed.)', ', eds.)')}")
_CAR_TITLE = dot(f"title || {on('edition <> ' + chr(39) * 2, repr(', ') + ' || coalesce([' + ', '.join(repr(w) for w in ('First', 'Second', 'Third', 'Fourth', 'Fifth', 'Sixth', 'Seventh', 'Eighth', 'Ninth', 'Tenth')) + '][edition::INT], edition || ' + repr('th') + ') || ' + repr(' Edition'))}")
_CAR_NUMBERS = on("volume <> ''", "volume || " + on("issue <> ''", "'(' || issue || ')'"))
_CAR_JOURNAL = dot(on("volume <> '' AND pages <> ''", f"container || ', ' || {_CAR_NUMBERS} || ':' || pages", j(", ", "container", _CAR_NUMBERS, "pages")))
_CAR_IMPRINT = dot(j(", ", "publisher", "place"))
_CAR_HELD = f"{on('pages <> ' + chr(39) * 2, repr('Pp. ') + ' || pages || ' + repr(', in '), repr('In '))} || container || {_CAR_EDS} || '.'"
_CAR_PART = on("volume <> '' AND publisher <> ''", f"'In ' || container || {_CAR_EDS} || '. ' || publisher || ', ' || volume || {pre(':', 'pages')} || '.'", j(" ", _CAR_HELD, _CAR_IMPRINT))
_CAR_END = pre("Available from ", "link")
_CAR_REPORT = j(" ", dot("container"), _CAR_IMPRINT)
CARNEGIE = style(
    _either(listed(_ONE_FIRST("a"), pair=","), f"({listed(_ONE_FIRST('e'), pair=',')}) || {_eds(' (ed.)', ' (eds.)')}"),
    journal=j(" ", dot("who"), _CAR_YEAR, _CAR_TITLE, _CAR_JOURNAL), book=j(" ", dot("who"), _CAR_YEAR, _CAR_TITLE, _CAR_IMPRINT), chapter_proceedings=j(" ", dot("who"), _CAR_YEAR, dot("title"), _CAR_PART),
    thesis=j(" ", dot("who"), _CAR_YEAR, dot("title"), dot(j(", ", "'Unpublished Ph.D. Dissertation'", "publisher", "place"))), preprint=j(" ", dot("who"), _CAR_YEAR, dot("title"), "container || ' preprint.'", _CAR_END),
    other=j(" ", dot("who"), _CAR_YEAR, dot("title"), _CAR_REPORT),
)

STYLES = {"apa": APA, "mla": MLA, "chicago": CHICAGO, "harvard": HARVARD, "vancouver": VANCOUVER, "ieee": IEEE, "carnegie": CARNEGIE}
_NL, _CRLF = "' || chr(10) || '", "' || chr(13) || chr(10) || '"
_KEY_WORDS = "list_filter(regexp_split_to_array(title, '[\\s‐-―/-]+'), lambda w: regexp_matches(w, '[A-Za-z]{3,}') AND NOT regexp_full_match(lower(w), 'the|and|for|with|from|into|over|under|that|this|are|was|were|its|our|their'))"
_KEY_NAME = "coalesce(a[1].fam, e[1].fam)"
_KEY = f"CASE WHEN {_KEY_NAME} IS NOT NULL THEN {_KEY_NAME} || year || ({_KEY_WORDS})[1] ELSE upper(({_KEY_WORDS})[1][1]) || lower(({_KEY_WORDS})[1][2:]) || year || coalesce(({_KEY_WORDS})[2], '') END"
_FIELD = lambda key, value: on(f"{value} <> ''", f"'  {key} = {{' || {value} || '}}'")
_PROTECTED = "array_to_string(list_transform(string_split(title, ' '), lambda w, i: CASE WHEN lower(w) = w OR (i = 1 AND lower(w[2:]) = w[2:]) THEN w ELSE '{' || w || '}' END), ' ')"
_BIB_TYPES = "CASE kind WHEN 'journal' THEN 'article' WHEN 'chapter' THEN 'incollection' WHEN 'book' THEN 'book' WHEN 'proceedings' THEN 'inproceedings' WHEN 'thesis' THEN 'phdthesis' WHEN 'report' THEN 'techreport' ELSE 'misc' END"
_HOLDER = "CASE WHEN kind = 'journal' THEN '  journal = {' WHEN kind IN ('chapter', 'proceedings') THEN '  booktitle = {' WHEN kind = 'book' THEN '  series = {' ELSE '  howpublished = {' END || container || '}'"
_BODY = on("publisher <> ''", "CASE kind WHEN 'thesis' THEN '  school = {' WHEN 'report' THEN '  institution = {' ELSE '  publisher = {' END || publisher || '}'")
_BIB_ROWS = j(
    f",{_NL}", _FIELD("title", _PROTECTED), _FIELD("author", "array_to_string(a_bn, ' and ')"), _FIELD("editor", "array_to_string(e_bn, ' and ')"), _HOLDER, _FIELD("edition", "edition"), _FIELD("volume", "volume"),
    _FIELD("number", "issue"), _FIELD("pages", "replace(pages, '-', '--')"), _FIELD("year", "year"), on("month > 0", f"'  month = ' || lower({month('nlm')})"), _BODY, _FIELD("address", "place"), _FIELD("doi", "doi"),
    _FIELD("url", "link"), on("kind = 'preprint'", "'  note = {Preprint}'"),
)
_ROW = lambda tag, value: on(f"{value} <> ''", f"'{tag}' || {value}")
_EACH = lambda tag, names, by: f"array_to_string(list_transform({names}, lambda p: '{tag}' || p), '{by}')"
_RIS_ROWS = j(
    _CRLF, "'TY  - ' || CASE kind WHEN 'journal' THEN 'JOUR' WHEN 'chapter' THEN 'CHAP' WHEN 'book' THEN 'BOOK' WHEN 'proceedings' THEN 'CONF' WHEN 'preprint' THEN 'UNPB' WHEN 'thesis' THEN 'THES' ELSE 'RPRT' END",
    _EACH("AU  - ", "a_tg", _CRLF), _EACH("ED  - ", "e_tg", _CRLF), "'TI  - ' || title", "'T2  - ' || container", _ROW("ET  - ", "edition"), _ROW("VL  - ", "volume"), _ROW("IS  - ", "issue"),
    on("p2 <> ''", f"'SP  - ' || p1 || '{_CRLF}EP  - ' || p2", _ROW("SP  - ", "p1")), _ROW("PY  - ", "year"), on("year <> ''", "'DA  - ' || year || '/' || CASE WHEN month > 0 THEN lpad(month::VARCHAR, 2, '0') ELSE '' END || '//'"),
    _ROW("PB  - ", "publisher"), _ROW("CY  - ", "place"), _ROW("DO  - ", "doi"), _ROW("UR  - ", "link"), "'ER  - '",
)
_ENW_ROWS = j(
    _NL, "'%0 ' || CASE kind WHEN 'journal' THEN 'Journal Article' WHEN 'chapter' THEN 'Book Section' WHEN 'book' THEN 'Book' WHEN 'proceedings' THEN 'Conference Paper' WHEN 'preprint' THEN 'Unpublished Work' WHEN 'thesis' THEN 'Thesis' ELSE 'Report' END",
    _EACH("%A ", "a_tg", _NL), _EACH("%E ", "e_tg", _NL), "'%T ' || title", "CASE WHEN kind = 'journal' THEN '%J ' ELSE '%B ' END || container", _ROW("%7 ", "edition"), _ROW("%V ", "volume"), _ROW("%N ", "issue"), _ROW("%P ", "pages"),
    _ROW("%D ", "year"), on("month > 0", f"'%8 ' || {month('full')}"), _ROW("%I ", "publisher"), _ROW("%C ", "place"), _ROW("%R ", "doi"), _ROW("%U ", "link"),
)
_BIBTEX = f"'@' || {_BIB_TYPES} || '{{' || {_KEY} || ',{_NL}' || {_BIB_ROWS} || '{_NL}}}'"
SQL = {f"style_{k}": v for k, v in STYLES.items()} | {
    "export_bibtex": f"{MADE} SELECT id, {_BIBTEX} AS text FROM g",
    "export_ris": f"{MADE} SELECT id, {_RIS_ROWS} || '{_CRLF}' AS text FROM g",
    "export_endnote": f"{MADE} SELECT id, {_ENW_ROWS} || '{_NL}' AS text FROM g",
    "all_styles": " UNION ALL ".join(f"SELECT id, '{k}' AS style, text FROM ({v})" for k, v in STYLES.items()),
    "list_frame": f"""SELECT publisher, id, CASE WHEN good THEN number || '. ' || text ELSE text END AS line FROM (
  SELECT coalesce(w.publisher, '') AS publisher, t.id, text, w.doi IS NOT NULL AS good, count(w.doi) OVER (PARTITION BY w.publisher ORDER BY t.id) AS number
  FROM ({VANCOUVER}) t JOIN (WITH {WORKS_SQL} SELECT id, publisher, doi FROM works) w ON t.id = w.id)""",
    "export_files": f"""{MADE} SELECT publisher, count(*) FILTER (doi <> '') AS matched, count(*) FILTER (doi = '') AS missed,
  sha256(coalesce(string_agg({_BIBTEX}, chr(10) || chr(10) ORDER BY id) FILTER (doi <> ''), '')) AS content_sha256 FROM g GROUP BY publisher""",
}

# HTML: the titles that a kind sets in italics; texts of the derived works hold no character that HTML escapes.
_IT = lambda x: f"'<i>' || {x} || '</i>'"
_HTML_DOT = lambda x: f"""regexp_replace({x}, '([^.?!”’"''>]|[^.?!”’"''][”’"''])(</i>)?$', '\\0.')"""
_HTML_NUMBERS = on("volume <> '' OR issue <> ''", f"{on(chr(118) + 'olume <> ' + chr(39) * 2, _IT('volume'))} || {on('issue <> ' + chr(39) * 2, repr('(') + ' || issue || ' + repr(')'))}")
_HTML_PART = _APA_PART.replace("|| container ||", f"|| {_IT('container')} ||")
_HTML_THESIS = _APA_THESIS.replace("title ||", f"{_IT('title')} ||", 1)
SQL["style_html"] = style(
    _either(_APA_LIST("a"), f"{_APA_LIST('e')} || {_eds(' (Ed.)', ' (Eds.)')}"),
    journal=_apa(dot("title"), f"{j(', ', _IT('container'), _HTML_NUMBERS, 'dashed')} || '.'"), chapter_proceedings=_apa(dot("title"), _HTML_PART),
    book=_apa(on("ed <> ''", f"{_IT('title')} || ' (' || ed || ').'", f"{_IT('title')} || '.'"), on(_AUTHOR_IS("publisher"), "''", dot("publisher"))),
    thesis=_apa(_HTML_THESIS, "''"), other=_apa(f"{_IT('title')} || '.'", on(_AUTHOR_IS("container"), "''", dot("container"))),
)
SQL["style_html"] = f"SELECT id, replace(text, '&', '&amp;') AS html FROM ({SQL['style_html']})"

_LETTERED = f"""{MADE}, k AS (SELECT id, lower(coalesce(a[1].fam, e[1].fam)) AS family, year, regexp_replace(lower(title), '^(a|an|the) ', '') AS key FROM g),
r AS (SELECT id, family IS NOT NULL AND year <> '' AND count(*) OVER (PARTITION BY family, year) > 1 AS several, row_number() OVER (PARTITION BY family, year ORDER BY key, id) - 1 AS n FROM k),
s AS (SELECT id, CASE WHEN NOT several THEN '' WHEN n < 26 THEN chr((97 + n)::INT) ELSE chr((96 + n // 26)::INT) || chr((97 + n % 26)::INT) END AS letter FROM r)"""
SQL["style_apa_lettered"] = APA.replace(MADE, f"{_LETTERED}, g2 AS (SELECT g.* REPLACE (year || letter AS year) FROM g JOIN s USING (id))").replace("AS who FROM g)", "AS who FROM g2)")
_CITED = lambda word, oxford, least: f"CASE WHEN len(fam) = 0 THEN '' WHEN len(fam) >= {least} THEN fam[1] || ' et al.' ELSE {listed('fam', word, oxford)} END"
_PART = on("kind IN ('journal', 'chapter', 'proceedings', 'thesis')", "'“' || title || '”'", "title")
_OR = lambda who: f"coalesce(nullif({who}, ''), {_PART})"
_ND = on("year <> ''", "year || letter", "'n.d.'")
SQL["in_text_forms"] = f"""{_LETTERED}, c AS (SELECT g.*, letter, CASE WHEN len(a) > 0 THEN a_fm ELSE e_fm END AS fam FROM g JOIN s USING (id))
SELECT id, '(' || {_OR(_CITED(' & ', '', 3))} || ', ' || {_ND} || ')' AS apa, {_OR(_CITED(' and ', '', 3))} || ' (' || {_ND} || ')' AS apa_narrative,
  '(' || {_OR(_CITED(' and ', '', 4))} || ', ' || {on("year <> ''", "year || letter", "'no date'")} || ', pp. 5–6)' AS harvard,
  '(' || CASE WHEN len(fam) = 0 THEN container WHEN len(fam) > 2 THEN fam[1] || ' et al.' ELSE array_to_string(fam, ' and ') END || ' ' || {_ND} || ':5–6)' AS carnegie,
  '(' || {_OR(_CITED(' and ', '', 3))} || ' 5)' AS mla, '[1, p. 5]' AS ieee, {j(", ", _CITED(" and ", ",", 4), _PART)} || '.' AS chicago_short FROM c"""
_JSON = lambda key, value: f"CASE WHEN {value} <> '' THEN '\"{key}\":\"' || {value} || '\"' ELSE '' END"
_JSON_PEOPLE = lambda key, who: (
    f"CASE WHEN len({who}) > 0 THEN '\"{key}\":[' || array_to_string(list_transform({who}, lambda p: CASE WHEN p.lit THEN '{{\"literal\":\"' || p.fam || '\"}}' "
    f"ELSE '{{\"family\":\"' || p.fam || '\",\"given\":\"' || p.given || '\"}}' END), ',') || ']' ELSE '' END"
)
_JSON_YEAR = """CASE WHEN year <> '' THEN '"issued":{"date-parts":[[' || year || ']]}' ELSE '' END"""
SQL["export_json"] = (
    f"{MADE} SELECT id, '{{' || "
    + j(",", _JSON("type", "type"), _JSON("title", "title"), _JSON_PEOPLE("author", "a"), _JSON_PEOPLE("editor", "e"), _JSON("container-title", "container"), _JSON_YEAR, _JSON("volume", "volume"), _JSON("issue", "issue"), _JSON("page", "pages"), _JSON("publisher", "publisher"), _JSON("DOI", "doi"))
    + " || '}' AS json FROM g"
)
