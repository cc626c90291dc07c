"""Template residue, filler, error and script notices instead of content (problem 4).

Method: character n-gram models of filler, error notices, script notices and natural prose are fitted; windows
(sentences) whose likelihood ratio favours residue are localised, and a page is excluded by the share of its text that
they cover. What fits the syntax of a placeholder is judged by its window in the same way: models of the text around
values and around placeholders that a text explains decide whether a value is missing.

What the models are fitted on: status texts of the standard library and sentences put together by rule, in several
languages; public-domain filler; and, learned from the corpus itself, the windows that recur on pages which hold little
else (`recurring`), against all its other lines. The corpus is counted whole, for both sides and in every round; the rule's
sentences are so broad that a corpus too small to learn from is judged by them alone.

Defined cases: null, empty and blank contents are none; side remarks and mentions inside real content
stay below the coverage; markup is stripped before; a page of chrome alone (menu, footer) is none.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from http import HTTPStatus

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.session import ship, staged, table

#: Lines of fewer characters are labels, no prose.
LEAST_LINE = 20
#: Weights of windows are whole numbers of this unit, so their sums are the same whatever the partitions.
UNIT = 1 << 20
#: Characters that are hashed at once.
CHARACTERS = 1 << 20
#: A window recurs from this share of all pages on, and on this many; so there are at most windows-a-page / share of them.
COMMON_SHARE, COMMON_PAGES = 0.0005, 5
#: A page is made of recurring windows if they cover so much of it; a window is residue if most pages that hold it are so made.
MADE_OF, MOST = 0.6, 0.6
#: Least mean log ratio that the rule's sentences must give a recurring window before it is learned.
PLAUSIBLE = -0.6
#: Rounds of leaving residue out of the prose model, and the share that an n-gram is given where it was not seen.
ROUNDS, FLOOR = 3, 2e-6
#: Windows from this ratio on are left out of the prose model: a little prose less harms it less than residue in it.
DOUBTFUL = -0.5
BUCKETS = 1 << 15
MIN_COVERAGE = 0.5
#: A window is residue from this mean log ratio per n-gram on.
MIN_RATIO = -0.1

def _each(*slots: str) -> list[str]:
    """Every sentence with one choice (they stand between bars) of each slot; Chinese and Japanese are joined without spaces."""
    out, space = [""], "" if re.search("[\u3040-\u30ff\u4e00-\u9fff]", "".join(slots)) else " "
    for slot in slots:
        out = [f"{o}{space}{c}".strip() for o in out for c in slot.split("|")]
    return out


#: Filler: public-domain prose that layouts are filled with (Cicero, De finibus 1.32), known pangrams, and words that
#: announce a text which is not there.
CICERO = [*re.split(r"(?<=[.?])\s+", "Sed ut perspiciatis, unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam eaque ipsa, quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt, explicabo. Nemo enim ipsam voluptatem, quia voluptas sit, aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos, qui ratione voluptatem sequi nesciunt, neque porro quisquam est, qui dolorem ipsum, quia dolor sit, amet, consectetur, adipisci velit, sed quia non numquam eius modi tempora incidunt, ut labore et dolore magnam aliquam quaerat voluptatem. Ut enim ad minima veniam, quis nostrum exercitationem ullam corporis suscipit laboriosam, nisi ut aliquid ex ea commodi consequatur? Quis autem vel eum iure reprehenderit, qui in ea voluptate velit esse, quam nihil molestiae consequatur, vel illum, qui dolorem eum fugiat, quo voluptas nulla pariatur? At vero eos et accusamus et iusto odio dignissimos ducimus, qui blanditiis praesentium voluptatum deleniti atque corrupti, quos dolores et quas molestias excepturi sint, obcaecati cupiditate non provident, similique sunt in culpa, qui officia deserunt mollitia animi, id est laborum et dolorum fuga.")]
FILLER = [
    "the quick brown fox jumps over the lazy dog", "franz jagt im komplett verwahrlosten taxi quer durch bayern", "portez ce vieux whisky au juge blond qui fume", "el veloz murciélago hindú comía feliz cardillo y kiwi", "съешь же ещё этих мягких французских булок, да выпей чаю",
    *_each("add|type|write|put|paste|enter|insert|place", "your|the|some|more|body", "text|copy|content|words|description|paragraph", "in this box|into this area|at this point|here later"),
    *_each("dummy|sample|placeholder|filler|demo|example|test", "text|copy|content|paragraph|words", "for the layout|only|to be replaced later|used for testing|follows"),
    *_each("text|copy|content|description|details|more information", "to follow|to be announced|to be added|will be added soon|will follow shortly|is coming soon|not yet available", ""),
    *_each("this page|this section|the site", "is still being built|is under construction|will be launched soon|is coming soon", ""),
    "tba", "n/a n/a n/a", "foo bar baz", "bla bla bla", "blah blah blah", "abc abc abc", "aaaa aaaa", "asdfgh jkl", "qwertz qwertz", "lipsum", "test test",
    *_each("dies ist ein|nur ein|hier folgt ein", "blindtext|platzhaltertext|fülltext|mustertext|beispieltext", "für das layout|zum testen"), *_each("der text|der inhalt|die beschreibung", "folgt in kürze|wird noch ergänzt|kommt später", ""),
    *_each("ceci est un|un simple", "texte", "fictif|d’exemple|provisoire|de démonstration"), *_each("le texte|le contenu", "sera ajouté bientôt|arrive bientôt|est à compléter", ""),
    *_each("este es un|un simple", "texto", "de prueba|ficticio|provisional|de muestra"), *_each("el texto|el contenido", "se añadirá pronto|estará disponible en breve", ""),
    *_each("это|просто", "текст|образец текста", "для примера|для заполнения|заглушка"), "текст будет добавлен позже", "содержание скоро появится",
    *_each("这是|仅为", "示例文本|占位文本|测试文字|演示内容", ""), "文字内容待补充", "内容即将上线", "在此输入文字", "ここにテキストを入力します", "ダミーテキストです", "texto de exemplo", "testo segnaposto", "conteúdo em breve", "voorbeeldtekst komt later",
]
#: Errors and refusals: the status texts of the standard library, and sentences made of what is missing and what befell it.
ERRORS = [
    *[f"{lead}{status.phrase}" for status in HTTPStatus if status >= 400 for lead in ("0 ", "error 0: ", "http 0 ")],
    *[status.description for status in HTTPStatus if status >= 400 and status.description],
    *_each("the requested resource|the document you wanted|this address|that file|the article|the item|this link|the listing|the profile|the content", "could not be found|was not found on this server|is not available right now|is currently unavailable|has been removed|was deleted|has expired|does not exist any more|could not be loaded|failed to load|cannot be shown|has moved to another address"),
    *_each("we|sorry, we|we are sorry, but we", "could not|cannot|are unable to", "find|load|show|open|reach|process", "what you were looking for|the page you wanted|this page right now|your request"),
    *_each("an|an unexpected|an internal|a fatal|a temporary", "error|server error|application error|exception|problem", "occurred|has occurred while processing your request|was encountered|on our side"),
    *_each("something|that", "did not work|broke on our end|went amiss|failed unexpectedly", ""), *_each("please|kindly", "try again later|retry in a moment|refresh the page|come back in some minutes|check the address and try again|contact support"),
    *_each("the server|our service|this site|the database|the backend|the connection", "is overloaded|is down for maintenance|is not responding|timed out|refused the connection|is temporarily offline|closed the connection|failed to respond in time"),
    *_each("access|entry|your request|your ip address|this visit|your account", "was refused|has been restricted|was rejected by our firewall|is not permitted|has been banned|was blocked for security reasons|is forbidden from your location"),
    *_each("you", "are not allowed to|are not authorised to|do not have the rights to|must log in to|need permission to", "see this page|open this document|access this resource|use this area"),
    *_each("you have sent|you made|we received", "too many requests|more queries than allowed|an unusual number of requests", "in a short time|from your network|please slow down"),
    *_each("session|login|token|link", "expired, please sign in again|timed out|is invalid|is no longer valid", ""), *_each("go|take me|return|click to go", "back to the|to the", "main page|start|homepage|front page"), "use the search or the menu to find it", "the web master has been told",
    *_each("cannot|could not|unable to|failed to", "open|read|connect to|load|query|include", "the database|file 0|the socket|module 0|the template|stream 0"), "syntax error near line 0", "stack trace", "call stack: main 0", "null pointer exception at line 0", "segmentation fault", "undefined index in 0 on line 0", "reference id 0", "incident number 0", "error code 0", "trace id: 0", "support id 0",
    *_each("die angeforderte seite|das dokument|die datei|der artikel|der inhalt", "wurde nicht gefunden|existiert nicht mehr|ist nicht verfügbar|konnte nicht geladen werden|wurde gelöscht|ist umgezogen"), *_each("es ist ein|leider ist ein|ein", "fehler|interner fehler|serverfehler|unerwarteter fehler", "aufgetreten|passiert"), *_each("der zugriff|ihre anfrage|der zugang", "wurde verweigert|ist gesperrt|wurde abgelehnt|ist nicht erlaubt"), "bitte versuchen sie es später erneut", "zurück zur hauptseite", "zur startseite gehen", "sie haben keine berechtigung für diese seite", "der server ist überlastet", "zu viele anfragen in kurzer zeit",
    *_each("la page demandée|le document|le fichier|l’article|le contenu", "n’a pas été trouvé|n’existe plus|n’est pas disponible|n’a pas pu être chargé|a été supprimé|est introuvable"), *_each("une|désolé, une", "erreur|erreur interne|erreur du serveur|erreur inattendue", "s’est produite|est survenue"), *_each("l’accès|votre demande", "a été refusé|est interdit|a été bloqué"), "veuillez réessayer plus tard", "retourner à la page d’accueil", "vous n’avez pas les droits nécessaires", "le serveur est surchargé", "trop de requêtes",
    *_each("la página solicitada|el documento|el archivo|el artículo|el contenido", "no se ha encontrado|ya no existe|no está disponible|no se pudo cargar|ha sido eliminado"), *_each("se ha producido|ocurrió", "un error|un error interno|un error del servidor|un error inesperado", ""), *_each("el acceso|su solicitud", "ha sido denegado|está prohibido|fue bloqueado"), "por favor, inténtelo más tarde", "volver a la página principal", "no tiene permiso para ver esto", "el servidor está sobrecargado", "demasiadas solicitudes",
    *_each("запрошенная страница|документ|файл|статья", "не найдена|больше не существует|недоступен|не удалось загрузить|был удалён"), *_each("произошла|возникла", "ошибка|внутренняя ошибка|ошибка на сервере|непредвиденная ошибка", ""), *_each("доступ|ваш запрос", "запрещён администратором|ограничен|отклонён|заблокирован"), "пожалуйста, попробуйте позже", "вернуться на главную", "слишком много запросов", "сервер перегружен",
    *_each("您访问的页面|请求的资源|该文件|此内容|该文章", "不存在|未找到|无法访问|已被删除|暂时不可用|加载失败"), *_each("系统|服务器|程序", "发生错误|出现异常|繁忙|内部错误|无响应"), "拒绝访问", "您没有权限查看此页", "请求被拦截", "请稍后再试", "回到首页", "请求过于频繁", "网关超时",
    *_each("お探しのページ|このファイル|コンテンツ", "は見つかりませんでした|は存在しません|は利用できません|は削除されました"), "エラーが発生しました", "アクセスが拒否されました", "しばらくしてから再度お試しください", "トップページへ戻る", "サーバーエラー", "페이지를 찾을 수 없습니다", "접근이 거부되었습니다", "오류가 발생했습니다",
    *_each("a página|o documento|o ficheiro", "não foi encontrada|já não existe|não está disponível"), "ocorreu um erro", "acesso negado", "tente novamente mais tarde", *_each("la pagina richiesta|il documento", "non è stata trovata|non esiste più|non è disponibile"), "si è verificato un errore", "accesso negato", "riprova più tardi", "pagina niet gevonden", "er is een fout opgetreden",
]
#: Demands for scripts and checks of the browser.
NOTICES = [
    *_each("please|you must|you have to|kindly", "activate|switch on|allow|turn on", "javascript|scripts|scripting|cookies", "to continue|to view this content|to use this service|for the full experience"),
    *_each("javascript|scripting|a script-capable browser|cookie support", "must be on|has to be enabled|is needed for this site|is turned off|is switched off|appears to be off|is not supported by your browser", ""),
    *_each("this application|our service|the content|the form|the map", "needs javascript|will not work without scripts|relies on javascript|cannot be shown without javascript", ""),
    *_each("your browser", "does not support javascript|blocks scripts|has javascript switched off|is out of date|could not be checked|is being checked", ""),
    *_each("we are|the system is|our firewall is", "checking your connection|verifying your browser|making sure that you are not a bot|running a security check", ""),
    *_each("prove|confirm|verify|show us", "that you are a person|you are not a robot|you are a real visitor", "to go on|by solving the puzzle|by ticking the box"),
    *_each("solve|answer|pass", "the puzzle|the security check|the challenge|this captcha", "to get in|to proceed|before you go on"), *_each("security check|browser verification|human check|redirecting you|connecting", "in progress|required|please stand by|this takes a few seconds"), "loading content, please stand by", "hold on a second", "protection against automated access", "performance and security provided",
    *_each("bitte|sie müssen", "javascript|skripte|cookies", "einschalten|im browser erlauben|zulassen", "um fortzufahren|um den inhalt zu sehen"), "diese anwendung benötigt javascript", "javascript ist ausgeschaltet", "wir prüfen ihren browser", "bestätigen sie, dass sie kein roboter sind", "einen augenblick, die seite wird geladen",
    *_each("merci d’|il faut|vous devez", "activer|autoriser", "javascript|les scripts|les cookies", "pour continuer|pour afficher le contenu"), "cette application nécessite javascript", "javascript n’est pas actif", "vérification de votre navigateur", "confirmez que vous n’êtes pas un robot", "chargement en cours",
    *_each("debe|por favor,", "activar|habilitar|permitir", "javascript|los scripts|las cookies", "para continuar|para ver el contenido"), "esta aplicación necesita javascript", "javascript está desactivado", "comprobando su navegador", "confirme que no es un robot", "cargando, espere por favor",
    *_each("пожалуйста,|необходимо", "включить|разрешить", "javascript|скрипты|cookies", "для просмотра|в браузере"), "для работы сайта нужен javascript", "javascript отключён", "проверка вашего браузера", "подтвердите, что вы не робот", "идёт загрузка",
    *_each("本站|此功能|该应用|浏览本文", "需要|必须|要求", "启用|开启|支持", "javascript|脚本|cookies", "才能使用|方可浏览|以正常运行"), *_each("请|您需要", "开启|允许|打开", "javascript|脚本|cookies", "以继续访问|后刷新页面"), "您的浏览器不支持脚本", "浏览器已禁用javascript", "安全验证中", "请完成人机验证", "正在加载，请稍候", "このサイトを利用するにはjavascriptを有効にしてください", "ブラウザを確認しています", "자바스크립트를 켜 주세요", "ative o javascript para continuar", "attiva javascript per continuare", "schakel javascript in om verder te gaan",
]
#: Sentences about such things; they count as prose.
ABOUT = [
    "Servers answered one request in ten with an error, the operators wrote in their yearly report.", "The article explains why some sites show an error when a document has been moved.", "Our readers complained that the old address led to a missing page for a week.", "Scripts on the portal load the map only after the visitor has agreed.", "The study compared how often pages ask visitors to switch on scripts.",
    "Filler such as Latin text was found in one of the drafts, the editor said.", "The word “forbidden” stood in the log each time the crawler was refused.", "A chapter on error handling describes when a server gives up and what the reader sees.", "Many visitors close the cookie banner without reading it, a survey found.", "The authors describe how a firewall tells people from programs.",
    "Der Bericht erklärt, warum manche Server mit einem Fehler antworten.", "Viele Leser nutzen die Seite ohne JavaScript, schreibt die Redaktion.", "Le rapport explique pourquoi certaines pages renvoient une erreur.", "El informe explica por qué algunas páginas devuelven un error.", "В отчёте объясняется, почему сервер отвечает ошибкой.", "报告解释了服务器为何返回错误。", "该研究统计了需要启用脚本的网页数量。",
]
#: What stands around a value (here a full stop in a ring) that a template fills in, and around one that a text explains.
SLOTS = [
    *_each("hello|hi|good morning|welcome|thank you", "◉,", "|your order ◉ is on its way|we have got your message|your appointment is on ◉"), *_each("by|from|author:|written by|posted by|edited by", "◉", "|on ◉|in ◉|, ◉"),
    *_each("phone:|mail:|price:|address:|date:|name:|city:|subject:|total:|status:|version|updated|last seen|created", "◉", "|, ◉|| ◉|at ◉"), *_each("the office of|news of|about|all about|results for|offers in", "◉", "|for ◉|and ◉|– ◉"), *_each("◉", "||, ◉|| ◉|: ◉|- ◉|(◉)|of ◉", ""),
    *_each("guten tag|hallo|liebe frau", "◉,", "|ihre bestellung ◉ ist da|die frist läuft am ◉ ab"), *_each("von|am|für|seit|preis:|telefon:|stand:", "◉", "|bis ◉|in ◉|endet"), *_each("bonjour|cher|chère", "◉,", "|votre commande ◉"), *_each("par|de|le|prix :", "◉", "|à ◉"), *_each("hola|estimado", "◉,", "|su pedido ◉"), *_each("por|de|el|precio:", "◉", "|en ◉"), *_each("от|для|цена:", "◉", ""), *_each("关于|来自|作者：|价格：|联系", "◉", "|的公告|◉"),
]
EXPLAINED = [
    *_each("the|a|each|this|every", "template|placeholder|variable|field|tag|token|marker|expression|snippet|macro", "◉", "is replaced with|stands for|must be filled with|prints|inserts|is written for|holds|expands to", "the name|the value|the date|a number"),
    *_each("the template language|the renderer|the parser|our script|the form|the engine|the mail program", "replaces|expands|turns|fills|reads|escapes", "◉", "with the|into the|from the|by the", "value|user’s name|day of the month"), *_each("write|use|put|type|set", "◉", "inside the string|in the template|in the form field|where the name should stand|and the program inserts it"), "the syntax ◉ marks a variable in a template", "fields such as ◉ are filled in by the clerk", "people forget to fill in ◉ in the form", "the documentation explains what ◉ means", "the string ◉ is a placeholder, not a value",
    *_each("der|die|jede", "vorlage|platzhalter|variable|feld", "◉", "wird ersetzt durch|steht für|enthält", "den namen|den wert"), *_each("le|la|chaque", "modèle|variable|champ", "◉", "est remplacé par|contient", "le nom|la valeur"), *_each("la|el|cada", "plantilla|variable|campo", "◉", "se sustituye por|contiene", "el nombre|el valor"), *_each("шаблон|поле|переменная", "◉", "заменяется на|содержит", "имя|значение"), *_each("模板|字段|变量|占位符", "◉", "会被替换为|表示|包含", "姓名|数值"),
]

_TAG = re.compile(r"<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->|<title\b[^>]*>.*?</title>|</?[A-Za-z][A-Za-z0-9:-]*(?:\s[^<>%]*)?/?>", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title>", re.S | re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])\s*")
#: Hosts and tokens with digits or joining signs tell nothing of the kind of text.
_HOST = re.compile(r"\b[\w-]+(?:\.[\w-]+)*\.(?:example|test|invalid|com|org|net|io)\b")
_HOST_END = re.compile(r"\.(?:example|test|invalid|com|org|net|io)\b")
_TOKEN_SIGN = re.compile(r"[0-9/_-]")
_TOKEN = re.compile(r"(?<![^\W\d_])[\w./-]*(?:\d|[a-z][-_/][a-z])[\w./-]*(?![^\W\d_])", re.I | re.A)
#: Syntaxes of values that a template should have filled in.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,60}%\}|<%=?[^%\n]{1,60}%>|<\?(?:=|php)[^?\n]{0,60}\?>|\$!?\{[\w.\[\]| ]{1,60}\}|\[\[[^\[\]\n]{1,60}\]\]|<<\w{2,40}>>|&lt;&lt;\w{2,40}&gt;&gt;"
    r"|%%\w{2,40}%%|%\(\w{1,40}\)[sdf]|##\w{2,40}##|__[A-Z][A-Z0-9_]{1,38}__|@Model\.\w+|(?<![\w$}])\{(?:\d{1,2}|[A-Z][A-Z0-9_]{2,40}|[a-z]+[._][\w.]{1,40})\}"
    r"|\[(?:your|insert|enter|add)\b[^\[\]\n]{1,50}\]|\[[A-Z]{3,}(?:[ _][A-Z]{2,}){0,5}\]|[［\[【]此处[^］\]】\n]{1,30}[］\]】]|\[object Object\]",
)
_INSERT = re.compile(r"\[(?:your|insert|enter|add)\b[^\[\]\n]{1,50}\]", re.I)
#: The trace of a filling that failed: a bare word of a program where a value belongs.
_FAILED = re.compile(r"(?<![\w.'’-])(?:undefined|NaN|null|None|nil)(?![\w'’-])")
_QUOTED = re.compile(r"`[^`\n]*`|[“\"«„'‘][^“”\"«»„\n]{0,80}[”\"»“'’]")


def visible_lines(content: str) -> list[str]:
    """Text of the page's lines without markup and title."""
    text = _TAG.sub(" ", content) if "<" in content else content
    return [t for line in text.split("\n") if (t := html.unescape(line).strip())]


#: What every placeholder and every trace of a failed filling holds; most pages have none of it.
_HINT = re.compile(r"[{\[［【]|<<|<%|<\?|&lt;&lt;|%%|%\(|##|__|@Model|undefined|NaN|null|None")


def has_placeholder(content: str, slots: np.ndarray) -> bool:
    """Whether a placeholder or the trace of a failed filling stands where a value belongs: `slots` are the log ratios of the
    models of the text around values and around explained placeholders."""
    if not _HINT.search(content):
        return False
    title = _TITLE.search(content)
    raw = _TAG.sub(" ", content) if "<" in content else content
    for line in ([title[1]] if title else []) + raw.split("\n"):
        line = line.strip()
        if not line or not _HINT.search(line):
            continue
        for sentence in _SENTENCE.split(line) if len(line) > 400 else [line]:
            plain = _QUOTED.sub(" ", sentence)
            marked, sure = PLACEHOLDER.subn("◉", plain)
            marked, sure_too = _INSERT.subn("◉", marked)
            marked, failed = _FAILED.subn("◉", marked)
            if sure + sure_too or failed:
                # a bare word must stand in a slot beyond doubt; a placeholder must not be explained
                ratio = _slot_ratio(marked, slots)
                if ratio > (MIN_SLOT if sure + sure_too == 0 else MAX_EXPLAINED):
                    return True
    return False


#: Mean log ratios that a window needs: more than the first where only its syntax speaks for a placeholder (it may lean to
#: an explanation a little), more than the second where the sign is a word that prose knows too.
MAX_EXPLAINED, MIN_SLOT = -0.25, 0.25
#: Characters on each side of a placeholder that its window takes in.
AROUND = 40


def _slot_grams(marked: str) -> np.ndarray:
    """N-grams of the text around the placeholders of one sentence; without any letter there is none."""
    near = " … ".join(marked[max(0, m.start() - AROUND) : m.end() + AROUND] for m in re.finditer("◉", marked))
    return grams(near) if re.search(r"[^\W\d_]", near) else np.zeros(0, np.int64)


def _slot_ratio(marked: str, slots: np.ndarray) -> float:
    found = _slot_grams(marked)
    # a line of placeholders alone is nothing but slots
    return float(slots[found].mean()) if len(found) else 1.0


def slot_ratios() -> np.ndarray:
    """Log ratio of each n-gram: text around values against text around explained placeholders."""
    sides = []
    for sentences in (SLOTS, EXPLAINED):
        counts = np.zeros(BUCKETS)
        for sentence in sentences:
            found = _slot_grams(sentence.replace("  ", " "))
            if len(found):
                counts += np.bincount(found, minlength=BUCKETS) / len(found)
        sides.append(counts / counts.sum() + 2e-5)
    return np.log(sides[0] / sides[1]).astype(np.float32)


def _shape(text: str) -> str:
    # the searches only tell where there is nothing to replace
    plain = _HOST.sub("example.test", text) if _HOST_END.search(text) else text
    plain = _TOKEN.sub("0", plain) if _TOKEN_SIGN.search(plain) else plain
    return " " + " ".join(plain.lower().split()) + " "


def grams(text: str) -> np.ndarray:
    """Hashed character n-grams of one window, n = 2 to 5."""
    return _hashed([text])[0]


def _counts(windows: list[str]) -> np.ndarray:
    bucket, owner = _hashed(windows)
    return _summed(bucket, owner, np.ones(len(windows), bool))


def _summed(bucket: np.ndarray, owner: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Counts over the windows taken; a window of n n-grams weighs the root of n."""
    weight = np.maximum(np.bincount(owner, minlength=len(taken)), 1) ** -0.5 * taken
    return np.bincount(bucket, weights=weight[owner], minlength=BUCKETS)


def windows(line: str) -> list[str]:
    """Sentences; one that repeats itself stands once."""
    return list(dict.fromkeys(s for s in _SENTENCE.split(line) if s.strip())) or [line]


SCRIPTS = ("latin", "cyrillic", "cjk")


def _script(text: str) -> str:
    return "cjk" if re.search("[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]", text) else "cyrillic" if re.search("[\u0400-\u04ff]", text) else "latin"


def _by_script(texts: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {s: [] for s in SCRIPTS}
    for text in texts:
        out[_script(text)].append(text)
    return out


@lru_cache(1)
def _ruled() -> dict[str, list[np.ndarray]]:
    """The models of the rule's sentences by script, one for each kind."""
    out: dict[str, list[np.ndarray]] = {s: [] for s in SCRIPTS}
    for sentences in (CICERO, FILLER, ERRORS, NOTICES):
        for script, own in _by_script(sentences).items():
            if own:
                counts = _counts([w + end for w in own for end in ("", ".")])
                out[script].append(counts / counts.sum())
    return out


def _ratios(prose: dict[str, np.ndarray], learned: list[str] = ()) -> np.ndarray:
    """Log ratio of each n-gram: the residue models and what was learned, against prose (counts by script), each script with
    the same weight on both sides; what neither side has seen counts 0."""
    for_residue, for_prose = np.zeros(BUCKETS), np.zeros(BUCKETS)
    found, about = _by_script(learned), _by_script(ABOUT)
    for script, models in _ruled().items():
        if found[script]:
            counts = _counts(found[script])
            # what was learned has as much weight as the rule's models together
            models = [*models, *[counts / counts.sum()] * len(models)]
        counts = _counts(about[script]) + prose[script]
        for_residue += np.mean(models, axis=0) / len(SCRIPTS)
        for_prose += counts / counts.sum() / len(SCRIPTS)
    return np.log((for_residue + FLOOR) / (for_prose + FLOOR)).astype(np.float32)


def _hashed(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, window) of every n-gram of the windows, hashed in one pass."""
    return _hashed_shapes([_shape(p) for p in parts])


def _hashed_shapes(shapes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, shapes), np.int64, len(shapes))
    codes = np.frombuffer("".join(shapes).encode("utf-32-le", "surrogatepass"), np.uint32)
    window = np.repeat(np.arange(len(shapes), dtype=np.int32), lengths)
    buckets, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    # the n-gram's polynomial modulo 2**32, each from the one a character shorter
    value, factor = codes, np.uint32(1_000_003)
    for n in (2, 3, 4, 5):
        if len(codes) < n:
            break
        value = value[:-1] * factor + codes[n - 1 :]
        seeded = (value + np.uint32(n * pow(1_000_003, n, 1 << 32) % (1 << 32))) & np.uint32(0x7FFFFFFF)
        inside = window[: len(value)] == window[n - 1 :]
        buckets.append(((seeded ^ (seeded >> np.uint32(13))) % np.uint32(BUCKETS)).astype(np.int32)[inside])
        owners.append(window[: len(value)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def _means(bucket: np.ndarray, owner: np.ndarray, n: int, ratios: np.ndarray) -> np.ndarray:
    return np.bincount(owner, weights=ratios[bucket], minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)


def residues(parts: list[str], ratios: np.ndarray, least: float = MIN_RATIO) -> np.ndarray:
    """Which of the windows are residue, by the mean log ratio of their n-grams."""
    return _means(*_hashed(parts), len(parts), ratios) >= least if parts else np.zeros(0, bool)


def residue(window: str, ratios: np.ndarray) -> bool:
    return bool(residues([window], ratios)[0])


def _page_windows(content: str) -> dict[str, int]:
    """The page's windows as shapes, with the characters that each covers; chrome and what is longer than a sentence is left out."""
    out: dict[str, int] = {}
    for line in visible_lines(content):
        if not _CHROME.match(line):
            for window in windows(line):
                shape = _shape(window)
                out[shape] = out.get(shape, 0) + len(shape)
    return out


def _window_hash(shape: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shape) - (1 << 63)


def recurring(contents: DataFrame, column: str) -> list[str]:
    """Windows that recur on pages which hold little else. The result is bounded: see COMMON_SHARE."""
    ship(contents.sparkSession)
    texts = contents.select(F.col(column).alias("content")).filter(F.col("content").rlike(r"\S"))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_window_hash(shape) for cell in batch.column(0) for shape in _page_windows(cell.as_py()) if len(shape) <= 300]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["window"])

    pages = texts.count()
    least = max(COMMON_PAGES, COMMON_SHARE * pages)
    common = {r["window"] for r in texts.mapInArrow(shapes, "window bigint").groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("window").collect()}
    if not common:
        return []

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, whole = [], []
            for cell in batch.column(0):
                sizes = _page_windows(cell.as_py())
                known = [shape for shape in sizes if _window_hash(shape) in common]
                # the longest window may be the headline of what should have stood there
                rest = [n for shape, n in sizes.items() if shape not in known]
                other = sum(rest) - (max(rest) if len(rest) == 1 else 0)
                if known:
                    covered = sum(sizes[shape] for shape in known)
                    names += known
                    whole += [covered >= MADE_OF * (covered + other)] * len(known)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(whole, pa.bool_())], names=["window", "whole"])

    found = texts.mapInArrow(made, "window string, whole boolean").groupBy("window").agg(F.avg(F.col("whole").cast("int")).alias("share"))
    return sorted(r["window"] for r in found.filter(F.col("share") >= MOST).collect())


def prose_windows(contents: DataFrame, column: str) -> DataFrame:
    """shape, script of the windows of every distinct line; those with a placeholder are no prose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w for line in batch.column(0) for text in visible_lines(line.as_py()) for w in windows(text) if not PLACEHOLDER.search(w)]
            yield pa.RecordBatch.from_arrays([pa.array([_shape(w) for w in found], pa.string()), pa.array([SCRIPTS.index(_script(w)) for w in found], pa.int32())], names=["shape", "script"])

    ship(contents.sparkSession)
    lines = contents.select(F.explode(F.split(column, "\n")).alias("line")).filter(F.length("line") >= LEAST_LINE).distinct()
    return lines.mapInArrow(run, "shape string, script int")


def prose_counts(prose: DataFrame, ratios: np.ndarray | None = None, known: set[str] = frozenset()) -> dict[str, np.ndarray]:
    """Weighted counts of the n-grams of all windows by script; with `ratios`, without the windows that these take for residue
    and without those known. A task adds its own up, so no more rows leave it than there are buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(SCRIPTS) * BUCKETS, np.int64)
        for batch in batches:
            shapes, scripts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            ends = np.cumsum([len(s) for s in shapes]) // CHARACTERS
            for part in np.split(np.arange(len(shapes)), np.flatnonzero(np.diff(ends)) + 1):
                own = [shapes[i] for i in part]
                bucket, owner = _hashed_shapes(own)
                sizes = np.bincount(owner, minlength=len(own))
                weight = np.rint(UNIT * np.maximum(sizes, 1) ** -0.5)
                if ratios is not None:
                    weight *= _means(bucket, owner, len(own), ratios) < DOUBTFUL
                    weight *= [s not in known for s in own]
                total += np.bincount(bucket + scripts[part][owner] * BUCKETS, weights=weight[owner], minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    ship(prose.sparkSession)
    out = np.zeros(len(SCRIPTS) * BUCKETS)
    summed = prose.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out[summed["bucket"].to_numpy()] = summed["n"].to_numpy() / UNIT
    return {script: out[k * BUCKETS : (k + 1) * BUCKETS] for k, script in enumerate(SCRIPTS)}


def train(contents: DataFrame, column: str) -> np.ndarray:
    """The log ratios. The prose model is fitted on every distinct line, less the windows that the models fitted before take for
    residue."""
    prose = staged(prose_windows(contents, column), "prose-windows")
    shapes = recurring(contents, column)
    # against all windows, itself included, what recurs must not look like prose
    ratios = _ratios(prose_counts(prose))
    learned = [w for w, ok in zip(shapes, residues(shapes, ratios, PLAUSIBLE)) if ok]
    for _ in range(ROUNDS):
        ratios = _ratios(prose_counts(prose, ratios, set(learned)), learned)
    return ratios


#: Lines of chrome say nothing for or against: stack frames, server names, copyright, menus, bare hosts.
_CHROME = re.compile(r"^(?:at [\w.$<>]+ ?\([\w./-]+:\d+(?::\d+)?\)|[a-z]+/\d[\d.]*(?: \([\w ]+\))?|©.*|(?:menu|menü|menú)\b.{0,40}|[\w-]+(?:\.[\w-]+)*\.(?:example|test|invalid|com|org|net)|[^.!?。]{0,60}(?:[|·].*){2,}|\W*)$", re.I)


def coverage(content: str, ratios: np.ndarray) -> tuple[float, int]:
    """(share of the text that residue covers, characters judged)."""
    lines = [line for line in visible_lines(content) if not _CHROME.match(line)]
    parts, of = [], []
    for number, line in enumerate(lines):
        sentences = windows(line)
        sentences = sentences if len(line) > 120 or len(sentences) == 1 else [line]
        parts += sentences
        of += [number] * len(sentences)
    found = residues(parts, ratios)
    # a headline above says what the page should have held
    headline = len(lines) > 1 and not re.search(r"[.!?…。！？]$", lines[0]) and of.count(0) == 1 and not found[0]
    sizes = np.array([len(p.strip()) for p in parts])
    if headline:
        sizes[0] = 0
    total = int(sizes.sum())
    return (float(sizes[found].sum()) / total if total else 0.0), total


SCHEMA = "rec_id bigint, reason string, coverage double"


def judged(rows: DataFrame, id_col: str, content_col: str, ratios: np.ndarray, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """rec_id, reason (placeholder or residue), coverage of the rows to exclude."""
    ship(rows.sparkSession)
    source = rows.filter(F.col(content_col).rlike(r"\S")).select(F.col(id_col).cast("bigint").alias("rec_id"), F.col(content_col).alias("content"))

    slots = slot_ratios()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, reasons, shares = [], [], []
            for rec_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = value.as_py()
                share, size = coverage(content, ratios)
                reason = "placeholder" if has_placeholder(content, slots) else "residue" if size and share >= min_coverage else None
                if reason:
                    ids.append(rec_id)
                    reasons.append(reason)
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(reasons, pa.string()), pa.array(shares, pa.float64())], names=["rec_id", "reason", "coverage"])

    return source.mapInArrow(run, SCHEMA)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "robust_result")
    return judged(pages, "robust_id", "content", train(pages, "content")).select(F.col("rec_id").alias("robust_id"))


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that stay: all columns of the rows that are no residue."""
    pages = table(spark, sf_dir, "robust_result")
    out = judged(pages, "robust_id", "content", train(pages, "content")).select(F.col("rec_id").alias("robust_id"))
    return pages.join(out, "robust_id", "left_anti").select("robust_id", "url", "channel", "challenge", "content")


ORACLES: dict[str, str] = {}
