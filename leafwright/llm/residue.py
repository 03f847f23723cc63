"""Template residue, filler and error pages in place of content.

Three detectors look at the running text, that is the text without code blocks, back-ticked
and quoted mentions:
 a) template fields that stand unfilled or filled with a failed value, and instructions to fill something in;
 b) paragraphs of filler: dummy Latin, a handful of words over and over, stock phrases, sentences that repeat;
 c) responses: apart from a title and navigation only error messages or notices.

For c the evidence of the corpus is combined: a sentence counts as a response where the
documents that hold it mostly hold nothing else (low information, duplicated, under
several sources, which stand for hosts, and titles); a sentence found mostly beside real content
is a mention. Status lines, traces and stock messages are known by form and need the
corpus only to show that they aren't mentions; a notice that no list knows is found by evidence alone.
There the title decides as well: a body that shares terms with its title is content.

Patterns are tried only where a text has a literal piece of them; the pieces are derived from the patterns.

Scale: one map over the texts that leaves hashes, aggregations over sentence hashes with
map-side combining, and a join of what bare documents say with the verdicts on it, each
verdict being dealt out `SALTS` times, so that a notice that a third of all documents hold isn't one task.
"""

from __future__ import annotations

import html
import re
from re import _constants as constants
from re import _parser as parser
from collections.abc import Iterator
from functools import cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.plans.lineage import cut

FENCE = re.compile(r"(?:^|\n)[ \t]*(```|~~~)[^\n]*\n.*?(?:\n[ \t]*\1|\Z)", re.S)
TICKS = re.compile(r"`[^`\n]+`")
NAME = r"[^\W\d_][\w.\-]{2,40}"
QUOTED = re.compile(r"“[^”\n]{1,200}”|„[^“”\n]{1,200}[“”]|「[^」\n]{1,200}」|『[^』\n]{1,200}』|‘[^’\n]{2,200}’|\"[^\"\n]{1,200}\"|«(?!" + NAME + r"»)[^»\n]{1,200}»")
FIELD = re.compile(
    r"\{\{\{?\s*" + NAME + r"\s*\}?\}\}|\$\{\s*" + NAME + r"\s*\}|%\(\s*" + NAME + r"\s*\)[sd]|\[%\s*" + NAME + r"\s*%\]|\{%\s*" + NAME + r"\s*%\}|##" + NAME + r"##|\[\[\s*" + NAME + r"\s*\]\]|«" + NAME + r"»|<<\s*" + NAME + r"\s*>>|<%=?\s*" + NAME + r"\s*%>"
    r"|\$[^\W\d_]{4,}[\w.\-]*\$|(?<![\w%])%[^\W\d_][\w.\-]{2,40}%(?![\w%])|(?<!\w)__[^\W\d_][\w.\-]{2,40}__(?!\w)|(?<![{\w\\])\{" + NAME + r"\}(?!\})|@@\s*" + NAME + r"\s*@@"
)
#: What a field is filled with when filling fails, and stand-ins for names.
FAILED = re.compile(r"(?<![A-Za-z0-9_#\[])(?:undefined|NaN|null|None|#REF!|#N/A|#VALUE!|#NAME\?|#DIV/0!|\[object Object\]|X{4,}|某某某?|[〇○]{3,}|\[object\])(?![A-Za-z0-9_(])")
#: Words by which a sentence explains a value.
EXPLAINS = re.compile(r"stands? for|\bmeans?\b|denotes?|is what|marks? |the (?:word|value|string|column)|bedeutet|steht für|signifie|significa|означает|betekent|表示|意味|뜻", re.I)
#: Words of instructions to fill something in, by language.
FILL_VERB = r"insert|enter|fill in|type|add|put|choose|select|complete|einfügen|eintragen|ergänzen|ausfüllen|eingeben|insérer|saisir|remplir|compléter|indiquer|insertar|escriba|escribir|indique|introduzca|rellen\w*|inserire|inserisci|compilare|scrivere|insira|inserir|preench\w*|escreva|invullen|vul|вставьте|вставить|впишите|введите|укажите|заполните|указать"
FILL_NAME = r"your|name|company|title|date|department|amount|nom|nombre|nome|naam|ihr|votre|su|seu|uw|имя|ваше|tbd|todo|firma|société|empresa|azienda|bedrijf|datum|fecha|data|дата|titel|titre|título|titolo|reviewer|author|here|hier|ici|aquí|qui|aqui|cognome|apellido|betrag|importe|importo|montant|valor|bedrag|сумма|сумму|название|отдел|organisation|address|phone"
BRACKETED = re.compile(r"[\[<【〔]([^\]>】〕\n]{2,60})[\]>】〕](?!\()|([(（])([^)）\n]{2,60})[)）]")
FILL_SQUARE = re.compile(r"\b(?:" + FILL_VERB + r"|" + FILL_NAME + r")\b|填|输入|輸入|記入|入力|입력|기입|작성", re.I)
FILL_ROUND = re.compile(r"^.{0,25}\b(?:" + FILL_VERB + r")\b|填|输入|輸入|記入|入力|입력|기입|작성", re.I)
NO_FILL = re.compile(r"^(?:/|!|sic\b|noscript|object|https?:|images/)", re.I)
#: Stems of dummy Latin.
LATIN = tuple("lorem ipsum dolor sit amet consec adipisc elit sed eiusmod tempor incidid labor magna aliqu enim minim veni quis nost exerci ullam nisi commod duis aut irur repreh volupt velit ess cillum fugi nulla paria except sint occae cupid non proid sunt culpa qui offici deser mollit anim est ut et in ex ea quip".split())
LATIN_RARE = tuple("lorem ipsum dolor amet consec aliqu cillum fugi nost ullam mollit irur velit sint duis except".split())
#: Stock phrases that stand where a text will be.
STOCK = re.compile(
    r"texte? à venir|faux texte|placeholder text|sample text|your (?:content|text) (?:goes )?here|text text text|body copy to follow|dummy text|здесь будет текст|текст-заполнитель|пример текста|hier steht später der text|beispieltext|blindtext|platzhaltertext|write a short description"
    r"|내용이 들어갑니다|예시 텍스트|샘플 텍스트|텍스트를 입력|hier komt de tekst|voorbeeldtekst|testo segnaposto|qui va il testo|testo di esempio|texto de (?:relleno|ejemplo|exemplo|preenchimento)|aquí va el texto|aqui (?:vai|entra) o texto|texto provisório|占位文本|示例文字|输入正文内容|ダミーテキスト|テキストが入ります|サンプルテキスト", re.I
)
#: Forms of error responses.
_REASON = r"Bad Request|Unauthorized|Payment Required|Forbidden|(?:Page )?Not Found|Method Not Allowed|Not Acceptable|Request Timeout|Conflict|Gone|Length Required|Payload Too Large|Too Many Requests|Internal Server Error|Not Implemented|Bad Gateway|Service Unavailable|Gateway Time-?out"
STATUS = re.compile(
    r"\b(?:HTTP|Error|Status)\b\W{0,3}[45]\d\d\b|(?:^|\s)#?\s?[45]\d\d\s*[-|:–]?\s*(?:" + _REASON + r")"
    r"|^\s*(?:Bad Request|Unauthorized|Forbidden|(?:Page )?Not Found|Request Timeout|Gone|Payload Too Large|Too Many Requests|Internal Server Error|Bad Gateway|Service Unavailable|Gateway Time-?out)[\s\-]*$|\"?error\"?\s*:\s*\"|\"status\"\s*:\s*[45]\d\d|(?:Fatal error|Warning|Parse error|Notice)\s*:|Traceback \(most recent|^\s*File \"[^\"]+\", line \d|\w+(?:Error|Exception)\b\s*:|Exception in thread|open stream|bytes exhausted", re.I | re.M
)
STATUS_CODE, TRACE = re.compile(r"^\s*#{0,3}\s*[45]\d\d\s*$"), re.compile(r"at [\w.$<>]+\([\w.]+(?::\d+)?\)")
#: Stock messages by language.
STOCK_ERROR = re.compile(
    r"java\s?script|\bcookies?\b|scripts? (?:are|is) (?:blocked|disabled|off)|allow (?:them|scripts)|(?:page|document|resource|link|file)\b.{0,40}\b(?:could not be found|not found|moved or removed|leads nowhere)|access (?:to .{0,40})?(?:is )?denied|not have permission|try again|too many (?:requests|uploads)|slow down|session (?:has )?expired|not a robot|back soon|went wrong|unexpected error|no backend|browser is not supported|could not be loaded"
    r"|nicht gefunden|zugriff verweigert|erneut versuchen|sitzung ist abgelaufen|blockiert skripte|introuvable|accès (?:refusé|interdit)|veuillez réessayer|sans les scripts|no se ha encontrado|acceso denegado|inténtelo|sin (?:los )?scripts|navegador|non (?:esiste|trovata)|accesso negato|riprovare|scripts? (?:siano|sono|est[áã]o?n?|zijn|staan)|did not (?:answer|respond)|timed out|não (?:foi )?encontrad|não existe|acesso negado|tente (?:novamente|de novo|mais tarde)|niet gevonden|toegang geweigerd|probeer het|не найден|доступ запрещ|повторите попытку|отключены скрипты|скрипт"
    r"|不存在|访问被拒绝|请先登录|禁用了脚本|脚本|请稍[后候]|请求过于频繁|服务器内部错误|見つかりません|アクセス.{0,6}拒否|エラーが発生|再度お試し|スクリプト|찾을 수 없|권한이 없|다시 시도|오류가 발생|스크립트|너무 많", re.I
)
NAV = re.compile(r"^\W*$|^(?:«|<|‹)\s*\w+$|^[^.!?。！？]{0,60}[|>›»·][^.!?。！？]{0,80}$|^©|^loading\W*$|^reload\W*$|^(?:ref|incident|request id|ray id|trace|id|code)\b[.:# ]*[\w\-]*$|^[\w\-]+/[\d.]+$|^\[?noscript\]?$|^(?:menu|search|sign in|home|help|back|login|upload|results)(?:\s+(?:menu|search|sign in|home|help|back|login|upload|results))*$|^-{3,}.*$|^\*+$|^[0-9a-f]{6,}\W*$|^#+\s*\d*$", re.I)
HTTP_CODE, HEADED = re.compile(r"[45]\d\d\b"), re.compile(r"(?:^|\s)#{1,3}$")
BREAK = re.compile(r"[.!?。！？\n](?:(?<=[.!?])\s+(?=[^\s\d])|(?<=[。！？])\s*|(?<=\n)\n*)")
PARAGRAPH_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n")
END = re.compile(r"[.!?。！？][\"')\]]*$")
LIST = re.compile(r"^\s*(?:[-*•·▪]|\d{1,3}[.)])\s+\S", re.M)
PARAGRAPH = re.compile(r"\n\s*\n")
DIGIT = re.compile(r"\d")
WORDS = re.compile(r"[^\W\d_]+")
IDEOGRAPH, HANGUL = re.compile("[぀-힯]"), re.compile("[가-힯]")
WORD_OR_SIGN = re.compile(r"[぀-鿿]|[^\W\d_]+")
NUMBERS, BLANKS, FIVE, RULE = re.compile(r"\d+"), re.compile(r"\s+(?=\S)"), re.compile(".{5}", re.S), re.compile(r"[-=_.~]{4,}")
#: Different words that a response has at most without its status lines, and those of them that may stand outside sentences, as a title does.
LOW, TITLE = 120, 20
#: Different words that a text without any known message has at most to be bare.
NOTICE = 30
_ENDS = (".", "!", "?", "。", "！", "？")  # what END asks for
_ENDINGS = (*_ENDS, "\n")
_FAILED_HINTS = ("undefined", "NaN", "null", "None", "#REF", "#N/A", "#VALUE", "#NAME", "#DIV", "[object", "XXXX", "某某", "〇〇", "○○")
TABLE_ROW = re.compile(r"^\s*\|.*\|\s*$", re.M)
ESCAPED = re.compile(r"\\([{}\[\]<>$%#_])")
_QUOTE, _MARK, _BRACKET = re.compile("[“„「『‘\"«]"), re.compile(r"[{$%«<_@\[#]"), re.compile("[\\[<【〔(（]")
_PLAIN = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {c: " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
_SPECIAL = re.compile("[" + "".join(map(chr, _PLAIN)) + "]")


def running_text(text: str) -> tuple[str, bool]:
    """The text without code and mentions, in plain characters; and whether it had a code block, table or image."""
    t = html.unescape(text) if "&" in text else text
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    if not t.isascii() and _SPECIAL.search(t):
        t = t.translate(_PLAIN)
    bare = FENCE.sub("\n", t) if "```" in t or "~~~" in t else t
    structure = bare != t or "![" in bare or ("|" in bare and bool(TABLE_ROW.search(bare)))
    if "`" in bare:
        bare = TICKS.sub(" ", bare)
    return ESCAPED.sub(r"\1", bare) if "\\" in bare else bare, structure


def unquoted(t: str) -> str:
    """A text without quoted mentions."""
    return QUOTED.sub(" ", t) if _QUOTE.search(t) else t


def _pieces(pattern, flags: int) -> set[str] | None:
    """Literal strings of which every match of a parsed pattern contains one, lower case; None where it has none."""
    options: list[set[str]] = []
    run = ""
    for op, value in [*pattern, (None, None)]:
        if op is constants.LITERAL:
            run += chr(value).lower()
            continue
        if run:
            options.append({run})
            run = ""
        if op is constants.BRANCH:
            parts = [_pieces(x, flags) for x in value[1]]
            if all(parts):
                options.append(set().union(*parts))
        elif op is constants.SUBPATTERN or (op in (constants.MAX_REPEAT, constants.MIN_REPEAT) and value[0]):
            inner = _pieces(value[-1], flags)
            if inner:
                options.append(inner)
    return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=None)


def hints_of(pattern: re.Pattern) -> set[str]:
    """Literal pieces, lower case, one of which every match of a pattern contains. Found from the parsed pattern, so that no alternative can be left out."""
    found = _pieces(parser.parse(pattern.pattern, pattern.flags), pattern.flags)
    if not found:
        raise ValueError(f"an alternative without a literal piece: {pattern.pattern[:60]}")
    return found


@cache
def _machine(kind: str):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for w in {"message": lambda: hints_of(STATUS) | hints_of(STOCK_ERROR), "stock": lambda: hints_of(STOCK), "latin": lambda: set(LATIN_RARE)}[kind]():
        machine.add_word(w, w)
    machine.make_automaton()
    return machine


def lowered(t: str) -> str:
    """Lower case as case-insensitive patterns see it."""
    t = t.lower()
    return t.replace("ſ", "s") if "ſ" in t else t


def hinted(kind: str, lower: str) -> bool:
    """Whether a lower-case text has a piece without which no pattern of that kind matches."""
    return next(_machine(kind).iter(lower), None) is not None


def has_code(t: str) -> bool:
    """Whether a number from 400 to 599 stands alone in a text, perhaps behind signs of a heading."""
    return any(HEADED.search(t, 0, m.start()) if m.start() and not t[m.start() - 1].isspace() else True for m in HTTP_CODE.finditer(t))


def has_template(t: str) -> bool:
    """(a) on a running text without mentions."""
    if any(FIELD.match(t, m.start()) for m in _MARK.finditer(t)):
        return True
    at = 0
    for opened in _BRACKET.finditer(t):
        m = BRACKETED.match(t, opened.start()) if opened.start() >= at else None
        if m is None:
            continue
        at = m.end()
        square, round_ = m.group(1), m.group(3)
        if square is not None and not NO_FILL.match(square) and (FILL_SQUARE.search(square) or (m.group()[0] == "<" and re.fullmatch(r"[A-Z][A-Z ]{4,40}", square))):
            return True
        if round_ is not None and not NO_FILL.match(round_) and FILL_ROUND.search(round_):
            return True
    for m in FAILED.finditer(t) if any(h in t for h in _FAILED_HINTS) else ():
        a = max(t.rfind(c, 0, m.start()) for c in ".!?。！？\n") + 1
        ends = [i for i in (t.find(c, m.end()) for c in ".!?。！？\n") if i >= 0]
        sentence = t[a : min(ends, default=len(t))]
        if EXPLAINS.search(sentence):
            continue
        if m.group() == "None" and (not t[a : m.start()].strip() or re.match(r" (?:of|the|are|is)\b", t[m.end() :])):
            continue
        if m.group() == "null" and re.match(r"\s*(?:und|Uhr|Komma|Grad)\b", t[m.end() :]):
            continue
        return True
    return False


def is_filler(paragraph: str, stock: bool = True, latin: bool = True) -> bool:
    """(b) for one paragraph of running text. `stock`, `latin`: whether the text has pieces of stock phrases and of dummy Latin."""
    p = paragraph.strip()
    if len(p) < 8 or p[0] in "|#" or "![" in p:
        return False
    return (_is_dummy(p, stock, latin) or _is_repetition(p)) and not LIST.search(p)


def _is_dummy(p: str, stock: bool, latin: bool) -> bool:
    """Dummy Latin or stock phrases."""
    if latin or stock:
        lower = lowered(p)
        if latin and hinted("latin", lower):
            words = WORDS.findall(lower)
            if len(words) >= 5 and sum(w.startswith(LATIN) and len(w) > 2 for w in words) >= 0.7 * len(words) and sum(w.startswith(LATIN_RARE) for w in words) >= 0.25 * len(words):
                return True
        rest = STOCK.sub("", p) if stock and hinted("stock", lower) else p
        if rest != p:
            sentences = paragraph_sentences(p)
            return sum(bool(STOCK.search(s)) for s in sentences) >= 0.7 * len(sentences) and (len(sentences) >= 2 or len(WORDS.findall(rest)) <= 6) and len(rest) < 0.75 * len(p) + 12
    return False


def _is_repetition(p: str) -> bool:
    """A handful of words over and over, sentences that repeat, or few different runs of five characters. Texts with digits are none."""
    if DIGIT.search(p):
        return False
    if len(set(WORDS.findall(p, 0, 200))) <= 17:  # the most that eight words in two cases can give, and a word that is cut
        words = WORDS.findall(p.lower())
        if len(words) >= 8 and len(set(words)) <= max(2, min(8, len(words) // 3)):
            return True
    if sum(map(p.count, _ENDINGS)) >= 3:
        sentences = paragraph_sentences(p)
        if len(sentences) >= 4 and len(set(sentences)) <= len(sentences) / 2:
            return any(WORDS.search(s) for s in sentences)
    if len(p) < 40 or RULE.search(p):
        return False
    least = 0.4 * (len(p) - 4)
    if len({*FIVE.findall(p), *FIVE.findall(p, 1), *FIVE.findall(p, 2)}) >= least:  # three fifths of the runs have enough different ones already
        return False
    return len({p[i : i + 5] for i in range(len(p) - 4)}) < least


def paragraph_sentences(p: str) -> list[str]:
    return [s for s in map(str.strip, PARAGRAPH_SENTENCE.split(p)) if s]


def sentence_key(s: str) -> int:
    """Hash of a sentence without its numbers and case."""
    if DIGIT.search(s):
        s = NUMBERS.sub("0", s)
    return xxhash.xxh64_intdigest(s.casefold().encode()) - (1 << 63)


def sentence_keys(s: str) -> list[int]:
    """Keys of a sentence and of its ends that begin with a word in capitals or without case: what goes before may be a title run into it."""
    starts = [m.end() for m in BLANKS.finditer(s) if not s[m.end()].islower() and s[m.end()].isalpha()]
    return [sentence_key(s), *(sentence_key(s[i:]) for i in starts)]


def sentences_of(t: str) -> list[str]:
    """Sentences and lines of a text; in scripts without blanks also the pieces between blanks."""
    out, at = [], 0
    for m in BREAK.finditer(t):
        i = m.start()
        out.append(t[at : i + (t[i] != "\n")].strip())
        at = m.end()
    out.append(t[at:].strip())
    if not t.isascii() and IDEOGRAPH.search(t):
        out = [x for s in out for x in (s.split() if " " in s and not HANGUL.search(s) and len(IDEOGRAPH.findall(s)) > len(s) / 2 else (s,))]
    return list(filter(None, out))


def without_mentions(s: str) -> str:
    return QUOTED.sub('""', s) if _QUOTE.search(s) and s[0] not in "{[" and 'File "' not in s else s


def information(text: str) -> int:
    """How many different words a text has; in scripts without blanks every character is one."""
    return len(set(WORD_OR_SIGN.findall(text.lower())))


def responses(t: str, structure: bool, title: str | None) -> tuple[bool, list[tuple[int, list[int], bool, bool]]]:
    """(c): whether a running text is bare, that is of low information and apart from a title and navigation only sentences that may be responses; and (number, keys, status line, reads like a message) of its sentences.

    A text without any message can be bare too: whether its sentences are responses is then for the corpus to say.
    """
    t = t.strip()
    if not t:
        return False, []
    pieces = sentences_of(t)
    if _QUOTE.search(t):
        pieces = [without_mentions(s) for s in pieces]
    lower = lowered(t)
    if hinted("message", lower) or has_code(t) or ("at " in lower and any(s.startswith("at ") for s in pieces)):
        marked = [hinted("message", lowered(s)) or has_code(s) or s.startswith("at ") for s in pieces]
    else:
        marked = [False] * len(pieces)
    if structure or _is_content(t, pieces, marked):
        return False, [(i, [sentence_key(s)], False, False) for i, (s, m) in enumerate(zip(pieces, marked)) if m or _ended(s)]
    found, loose, other, hits, told = [], set(), 0, 0, []
    for s, m in zip(pieces, marked):
        status = m and bool(STATUS.search(s) or TRACE.match(s) or STATUS_CODE.search(s))
        if not status and NAV.match(s):
            continue
        stock = m and bool(STOCK_ERROR.search(s))
        if status or stock:
            hits += 1
            found.append((s, status, True))
        elif _ended(s):
            other += 1
            found.append((s, False, False))
        else:
            loose.add(s)
        if not status:
            told.append(s)
    bare = bool(found) and (other <= hits or not hits) and len(LIST.findall(t)) < 3 and information(" ".join(loose)) <= TITLE and information(" ".join(told)) <= LOW
    if bare and title:
        terms = {w for w in WORDS.findall(title.lower()) if len(w) > 3}
        body = set(WORDS.findall(" ".join(s for s, _a, b in found if not b).lower()))
        bare = not (terms and len(terms & body) > len(terms) / 2)
    return bare, [(i, sentence_keys(s) if bare else [sentence_key(s)], a, b) for i, (s, a, b) in enumerate(found)]


def _ended(s: str) -> bool:
    return len(s) > 3 and s.rstrip("\"')]").endswith(_ENDS)


def _is_content(t: str, pieces: list[str], marked: list[bool]) -> bool:
    """Whether a text can't be bare whatever its marked sentences are: too many others, or without marked ones too many words."""
    most = sum(marked)
    if not most:
        return len(set(t.split())) > 2 * NOTICE or information(t) > NOTICE
    n = 0
    for s, m in zip(pieces, marked):
        if not m and _ended(s) and not NAV.match(s):
            n += 1
            if n > most:
                return True
    return False


EVIDENCE = "doc_id bigint, source string, title string, residue boolean, bare boolean, said array<struct<at:int,keys:array<bigint>,status:boolean,stock:boolean>>, others array<bigint>"
#: Parts into which the documents of one sentence are dealt.
SALTS = 32


def evidence(docs: DataFrame) -> DataFrame:
    """What each document's own text says: residue of kind a or b, bare, what it says if it is bare, and the keys of the sentences of one that isn't."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for doc, source, title, text in zip(p.doc_id, p.source, p.title, p.text):
                if not isinstance(text, str) or not text.strip():
                    rows.append((doc, source, None, False, False, [], []))
                    continue
                title = title if isinstance(title, str) else None
                t, structure = running_text(text)
                plain = unquoted(t)
                lower = lowered(plain)
                stock, latin = hinted("stock", lower), hinted("latin", lower)
                residue = has_template(plain) or any(is_filler(x, stock, latin) for x in PARAGRAPH.split(plain))
                bare, said = responses(t, structure, title)
                rows.append((doc, source, title if bare else None, residue, bare, [{"at": i, "keys": k, "status": a, "stock": b} for i, k, a, b in said] if bare else [], [] if bare else list({k[0] for _i, k, _a, _b in said})))
            yield pd.DataFrame(rows, columns=["doc_id", "source", "title", "residue", "bare", "said", "others"])

    return docs.select("doc_id", "source", "title", "text").mapInPandas(run, EVIDENCE)


def find(docs: DataFrame, least: int = 3, share: float = 0.6, sure: float = 0.8) -> DataFrame:
    """doc_id of documents with template residue, filler or nothing but a response.

    A sentence is a response where `least` bare documents or more under two sources or more hold it beside a message,
    and these are at least `share` of all documents that hold it; a stock message where at least `share` of
    its documents are bare, however few they are; a status line or trace always. A bare document is found when all
    its sentences are responses and one of them reads like a message, or when all are known by evidence alone: held by `least` bare documents
    under `least` sources and `least` titles, at least `sure` of all that hold them. Null and
    empty texts and null ids are never found; repeated rows are found once.
    """
    seen = cut(evidence(docs.where(F.col("doc_id").isNotNull())))
    said = seen.where("bare").select("doc_id", "source", "title", F.exists("said", lambda x: x["stock"]).alias("loud"), F.explode("said").alias("s")).select("doc_id", "source", "title", "loud", "s.at", "s.status", "s.stock", F.posexplode("s.keys").alias("part", "key"))
    by_bare = said.groupBy("key").agg(F.count("*").alias("n_bare"), F.count_if("loud").alias("n_loud"), F.approx_count_distinct(F.when(F.col("loud"), F.col("source")), 0.02).alias("loud_sources"), F.approx_count_distinct("source", 0.02).alias("sources"), F.approx_count_distinct("title", 0.02).alias("titles"))
    by_others = seen.select(F.explode("others").alias("key")).groupBy("key").agg(F.count("*").alias("n_others"))
    held = by_bare.join(by_others, "key", "left").withColumn("n", F.col("n_bare") + F.coalesce("n_others", F.lit(0)))
    whole = F.col("part") == 0  # the end of a sentence can only show that it is usual beside messages
    mostly = F.col("n_loud") >= share * F.col("n")
    many = mostly & (F.col("n_loud") >= least) & (F.col("loud_sources") >= 2)
    known = (F.col("n_bare") >= sure * F.col("n")) & (F.col("n_bare") >= least) & (F.col("sources") >= least) & (F.col("titles") >= least)
    verdicts = held.select("key", mostly.alias("mostly"), many.alias("many"), known.alias("known"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = said.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(verdicts, ["key", "salt"])
    each = joined.groupBy("doc_id", "at").agg(
        F.max(F.when(F.col("stock"), whole & (F.col("mostly") | F.col("status"))).otherwise(F.col("many"))).alias("beside"), F.max("stock").alias("stock"), F.max(whole & F.col("known")).alias("known")
    )
    bare = each.groupBy("doc_id").agg((F.max("stock") & F.min("beside") | F.min("known")).alias("response")).where("response").select("doc_id")
    return seen.where("residue").select("doc_id").unionByName(bare).distinct()
