"""Labelled exemplars of residue: passages of public pages, frameworks and template kits, by label.

A word in capitals stands for any word of the list of that name; ``a|b`` for one of several words.
SLOT stands for a placeholder, CODE for the number of a failed request.  Everything here is general
knowledge of server default pages, client frameworks, notices and templates; no corpus was read for
it.  The lists and passages are fixed values.
"""

from __future__ import annotations

LISTS = {
    # what a message may be about
    "THING": (
        "page pages site website webpage file document notebook resource item content article post link url address app application service server system repository project "
        "view viewer output cell widget widgets frame preview image map plot chart form dashboard report record session account object key path route location host backend origin "
        "upstream endpoint database proxy gateway network connection request response data user browser"
    ),
    "FETCH": (
        "fetch load open display show render retrieve read reach find get access serve view download connect process complete handle run establish answer respond deliver locate "
        "fetched loaded opened displayed shown rendered retrieved reached found served viewed downloaded processed completed handled answered responded received delivered located loading rendering responding"
    ),
    "GONE": (
        "missing moved removed deleted renamed unavailable expired broken exist exists existed longer gone disabled archived restricted private hidden changed mistyped invalid denied "
        "refused failed timed timeout down offline unreachable wrong unexpected temporarily permanently unable cannot available"
    ),
    "REASON": (
        "bad request unauthorized payment required forbidden not found method not allowed not acceptable proxy authentication required request timeout conflict gone length required "
        "precondition failed content payload too large uri too long unsupported media type range not satisfiable expectation failed misdirected unprocessable entity locked "
        "upgrade required too many requests unavailable for legal reasons internal server error not implemented bad gateway service unavailable gateway timeout"
    ),
    "SCRIPT": "javascript js script scripts scripting",
    "SUPPORT": "support supports supported supporting",
    "ENABLE": "enable enabled enabling turn turned switch switched activate activated allow allowed permit use run on",
    "WRITE": "write add insert enter type put paste describe fill provide replace edit give explain summarize state include specify define",
    "FIELD": (
        "title subtitle heading headline author authors name date version license section project metric dataset summary contact owner description topic subject email abstract "
        "text content paragraph caption comment comments note notes answer code solution conclusion introduction overview background goal objective purpose results findings details "
        "instructions example question task company team address phone image logo label slide page document cell column row value figure chart plot graph table method methods model experiment hypothesis "
        "observation observations reasoning thoughts thought explanation analysis interpretation discussion approach idea ideas plan progress contribution contributions motivation hypothesis limitation limitations reference references item list bullet point sentence sentences word words file path link number id "
        "category keyword keywords tag tags argument parameter function variable step steps problem data input output report story message reply greeting signature affiliation institution department biography bio paper article essay draft student course class grade signature quote keyword title"
    ),
}

#: Words a passage of any label may hold without telling anything.
COMMON = (
    "a an the this that these those it its is are was were be been being am has have had do does did don doesn didn can couldn cannot could may might must should will would won isn aren wasn t s re ve ll m "
    "not no you your yours we our us i my me they their there here in on at to of for from by with without and or but if when while as so than then also any all some more most other another "
    "only just too very what which who how where why please sorry oops hello dear thank thanks regards back again later now up out off into about after before during because due via per "
    "die der das ein eine ist wurde und oder bitte sie sie es um diese dieser zu zur in im mit für auf den dem nicht haben hat wenn noch "
    "la le les un une est a été et ou que qui vous nous votre pour ce cette ces de du des en dans sur pas ne plus l d n au aux si avez demandée demandé "
    "el los las una es ha sido y o que usted su por favor para este esta del al en no si lo se solicitada solicitado "
    "il lo gli una è stato e o che per favore questa questo di da non si del della "
    "o os as um uma é foi e ou que você seu sua por favor para este esta do da em não se "
    "или и не в на для была был это вы ваш пожалуйста что с по если запрошенная "
    "http https www html head body title doctype meta charset utf div span class href br hr lang en style center h1 h2 h3 true false null"
)

EXEMPLARS: dict[str, list[str]] = {
    "template": [
        "SLOT",
        "FIELD SLOT",
        "Hello SLOT welcome to SLOT, this message was sent to SLOT by the SLOT team",
        "Copyright SLOT all rights reserved",
        "Author SLOT Date SLOT Version SLOT",
        "your FIELD here",
        "your FIELD goes|belongs here",
        "WRITE your FIELD here|below",
        "WRITE FIELD here|below",
        "WRITE something here|below",
        "WRITE a short|brief FIELD of your|the FIELD",
        "WRITE a|an FIELD of|for your|this FIELD",
        "WRITE your own FIELD",
        "WRITE in your FIELD",
        "fill in the FIELD|blank|blanks",
        "FIELD goes here",
        "FIELD here",
        "this FIELD is intentionally left blank|empty",
        "this FIELD needs|requires a FIELD",
        "FIELD not yet written|available|provided",
        "no FIELD provided|yet|available",
        "describe in one|two|your words|sentences|sentence the FIELD",
        "what did you find|learn|observe|conclude",
        "in your own words",
        "WRITE the FIELD in your own words",
        "replace|substitute with a|your FIELD",
        "draft, FIELD to be added|written",
        "WRITE your FIELD and FIELD",
        "remove|delete this FIELD before|when submitting|publishing|done",
        "Write one|two|three|few sentences|paragraph about|describing your FIELD",
        "WRITE your FIELD in one|two|three|few sentences|words|paragraph|lines",
        "TODO WRITE FIELD",
        "TODO finish|complete|fill",
        "TBD FIELD",
        "FIELD to be added|written|completed|determined|announced|decided|confirmed",
        "FIELD coming soon",
        "coming soon, stay tuned",
        "this FIELD is under construction",
        "work in progress, FIELD to follow",
        "sample|placeholder|dummy|example FIELD",
        "placeholder FIELD, replace with your own",
        "replace this FIELD with your own FIELD",
        "click|tap here to add|enter|edit FIELD",
        "click to add FIELD",
        "double click or enter to edit",
        "edit this FIELD and describe your FIELD",
        "start typing here",
        "untitled FIELD|notebook|folder|file",
        "new section|slide|notebook|page|paragraph",
        "section|chapter|body|subtitle|title|heading|caption|footer FIELD",
        "heading one two three, item one, item two, item three, list item, bullet point, body text, some text goes here about the topic",
        "item one item two item three",
        "Project title, one paragraph of project description goes here",
        "What things you need to install the software and how to install them",
        "A step by step series of examples that tell you how to get a development env running",
        "Add additional notes about how to deploy this on a live system",
        "A clear and concise description of what the bug is",
        "If applicable, add screenshots to help explain your problem",
        "Add any other context about the problem here",
        "Describe the expected behavior and the steps to reproduce",
        "More information needed",
        "Provide a quick summary of what the model is",
        "Describe what you did in this cell and why",
        "Explain your reasoning here",
        "Escriba|Introduzca|Inserte aquí su texto|título|descripción",
        "Text|Beschreibung|Titel hier eingeben|einfügen|ergänzen", "Ihr|Ihren|Dein Text|Titel|Name hier",
        "votre texte|titre|nom ici", "écrivez|décrivez|ajoutez ici votre texte|description", "escriba|describa|añada aquí su|una descripción|texto", "su|tu texto|título|nombre aquí",
        "Ersetzen Sie diesen Text durch Ihren eigenen",
        "Remplacez ce texte par votre description",
        "Saisissez|Insérez votre texte|titre|description ici",
        "Inserisci|Scrivi qui il testo|titolo|descrizione",
        "Insira|Digite aqui o seu texto|título|descrição",
        "Введите|Вставьте здесь|сюда текст|описание|название",
        "在此输入文字", "在此处填写说明", "请输入标题", "ここに説明を書いてください", "ここにテキストを入力", "여기에 텍스트를 입력하세요",
    ],
    "filler": [
        "lorem ipsum",
        "foo bar",
        "bar baz",
        "foo baz|qux|quux",
        "asdf qwerty",
        "blah blah blah",
        "xxx",
        "the quick brown fox jumps over the lazy dog",
        "filler text filler text",
        "text text text, more text, some more text, even more text",
        "hamburgefonstiv adhesion",
        "Franz jagt im komplett verwahrlosten Taxi quer durch Bayern",
        "Portez ce vieux whisky au juge blond qui fume",
    ],
    "error": [
        "CODE REASON",
        "error CODE REASON",
        "status CODE error REASON",
        "timestamp status CODE error REASON message path",
        "error code CODE message REASON",
        "message REASON documentation url status",
        "code CODE reason REASON",
        "success error REASON",
        "type title REASON status CODE detail instance",
        "error message REASON detail",
        "detail not found",
        "message status code request id",
        "The requested URL was not found on this server",
        "The requested URL was not found on the server. If you entered the URL manually please check your spelling and try again",
        "A CODE not found error was encountered while trying to use an ErrorDocument to handle the request",
        "You do not have permission|permissions|access to FETCH this THING",
        "You need|require permission to FETCH this THING, ask|request the owner for access",
        "Access denied, sign|log in or contact the owner|administrator",
        "Server at localhost port",
        "The server encountered an internal error or misconfiguration and was unable to complete your request",
        "contact the server administrator and inform them of the time the error occurred and the actions you performed",
        "More information about this error may be available in the server error log",
        "The server is temporarily unable to service your request due to maintenance downtime or capacity problems",
        "The proxy server received an invalid response from an upstream server",
        "The gateway did not receive a timely response from the upstream server or application",
        "THING timed out",
        "THING did not answer|respond|reply|start",
        "THING is|are down|offline|unreachable|overloaded|restarting",
        "THING is|are temporarily|currently unavailable|down",
        "THING is|are under|undergoing maintenance",
        "permission denied",
        "access denied|forbidden|refused|restricted",
        "not authorized|authorised|allowed|permitted to FETCH this THING",
        "request rejected|blocked|refused|denied|cancelled",
        "connection refused|reset|closed|lost",
        "this THING is private|restricted|unavailable|gone",
        "this THING does not exist",
        "this THING cannot|could be FETCH",
        "THING not found",
        "THING unavailable",
        "nothing here|found|to show|display|see",
        "the THING you are|were looking for GONE",
        "wrong|broken|dead|invalid link|address|url",
        "check the address|url|link|spelling|connection and try again",
        "try again in a few minutes|moments|seconds",
        "wait a moment and reload|refresh|retry",
        "ask|contact the owner|author|administrator|support for access|help",
        "sign|log in to continue|view|see",
        "our team|engineers has|have been notified|informed",
        "you have been logged|signed out",
        "too many requests, wait a few seconds|minutes and retry",
        "down for scheduled|planned maintenance|upgrade",
        "we will be back|online shortly|soon",
        "we are working on it|fixing this|the problem",
        "return|go to the THING",
        "THING timed out",
        "THING timeout",
        "error occurred|happened",
        "an error occurred|happened while FETCH THING",
        "not available|accessible in your region|country|area",
        "Checking your browser before accessing, this process is automatic, your browser will redirect shortly",
        "Performance and security by, ray id, your ip",
        "Guru meditation cache server, backend fetch failed",
        "Application error: an error occurred in the application and your page could not be served, check your logs for details",
        "The page you were looking for does not exist, you may have mistyped the address or the page may have moved",
        "sorry but something|somethings went wrong",
        "something went wrong, try again later|reload|refresh|retry",
        "an unexpected|unknown error occurred|happened while processing|loading your request",
        "page|file|notebook|document not found",
        "this THING could|can not be found|loaded|displayed|reached|opened|rendered",
        "this THING is not|no longer available",
        "this THING has been moved|removed|deleted|renamed|archived",
        "this THING has moved|expired",
        "the THING you requested|followed|entered|want was|has|may GONE",
        "The link you followed may be broken or the page may have been removed",
        "The resource you are looking for has been removed, had its name changed, or is temporarily unavailable",
        "The service is unavailable",
        "The specified key does not exist",
        "That page can not be found, it looks like nothing was found at this location, maybe try a search",
        "Error establishing a database connection",
        "rate limit exceeded, slow down, wait seconds and try again",
        "Your session has expired, log|sign in again",
        "You must be logged|signed in to view this THING",
        "We could not|cannot FETCH this|the THING, try again later|retry",
        "unable|failed to FETCH THING",
        "could not|cannot FETCH THING",
        "THING was|is not served|found|loaded|fetched|rendered",
        "go|return|back to the start|home|previous|main page|homepage",
        "try reloading|refreshing the page or contact support if the problem persists",
        "request|reference|error|trace|correlation id",
        "we are experiencing|having technical difficulties|problems|issues",
        "come|check back later|soon|shortly",
        "technical difficulties|problems",
        "Seite|Datei|Dokument nicht gefunden|verfügbar|erreichbar",
        "Seite|Datei|Dokument|Daten|Inhalt konnte|konnten|kann|können nicht gefunden|geladen|angezeigt werden",
        "Seite|Datei|Dokument existiert nicht mehr", "Seite|Datei|Dokument wurde verschoben|gelöscht|entfernt",
        "Etwas ist schiefgelaufen", "Bitte versuchen Sie es später erneut|noch einmal", "Zurück zur Startseite", "Ein Fehler ist aufgetreten",
        "page|fichier|document est introuvable|indisponible", "page|fichier|document n existe plus", "page|fichier|document a été déplacé|déplacée|supprimé|supprimée", "veuillez réessayer plus tard", "retour à l accueil", "impossible de charger la|le page|fichier|document",
        "página|archivo|documento no existe|encontrada|encontrado|disponible", "página|archivo|documento ha sido|fue movida|eliminada|borrada", "inténtelo|vuelva|intente a intentarlo de nuevo más tarde", "volver al inicio", "no se pudo cargar la|el página|archivo",
        "страница|файл|документ не существует|найдена|найден|доступна", "страница|файл была|был удалена|удалён|перемещена", "что-то пошло не так", "попробуйте позже|снова",
        "Die angeforderte Seite existiert nicht, wurde verschoben oder gelöscht, versuchen Sie es später erneut",
        "Zugriff verweigert", "Interner Serverfehler",
        "Page|Fichier|Document introuvable|supprimé|déplacé",
        "La page demandée n existe pas|plus ou a été déplacée|supprimée, veuillez réessayer plus tard",
        "Accès refusé|interdit", "Une erreur est survenue|produite",
        "No se ha|pudo encontrado|encontrar la|el página|archivo solicitada|solicitado",
        "La página no existe|encontrada o ha sido movida|eliminada, inténtelo de nuevo más tarde",
        "Acceso denegado", "Se ha producido un error",
        "Pagina|File non trovata|trovato|disponibile", "Accesso negato", "Si è verificato un errore, riprova più tardi",
        "Página|Arquivo não encontrada|encontrado|existe", "Acesso negado", "Ocorreu um erro, tente novamente mais tarde",
        "Страница|Файл не найдена|найден|существует", "Доступ запрещён|запрещен", "Произошла ошибка попробуйте позже",
        "您访问的页面不存在", "页面未找到", "服务器错误请稍后再试", "お探しのページは見つかりません", "エラーが発生しました", "페이지를 찾을 수 없습니다",
    ],
    "scripts": [
        "You need to ENABLE SCRIPT to run|use|view this THING",
        "please ENABLE SCRIPT to continue|view|use|see this THING",
        "ENABLE SCRIPT and cookies to continue",
        "please ENABLE SCRIPT and reload|refresh the THING",
        "this THING requires|needs|uses SCRIPT",
        "SCRIPT is|are required|needed|necessary to view|use|run this THING properly",
        "SCRIPT must be ENABLE",
        "this THING works only with SCRIPT ENABLE",
        "SCRIPT is|are disabled|off|blocked|unavailable in your browser|viewer",
        "your browser|viewer does not support|run|allow|execute SCRIPT",
        "your browser has SCRIPT disabled|blocked|off",
        "We are sorry but this app does not work properly without SCRIPT ENABLE",
        "does|will not work|load|display without SCRIPT",
        "To use the full functionality of this site it is necessary to enable JavaScript, here are the instructions how to enable JavaScript in your web browser",
        "THING is|are blocked|hidden|empty because SCRIPT is|are disabled|blocked, nothing to display|show",
        "Make this notebook trusted to load map, file, trust notebook",
        "Loading widget|widgets|output|content, SCRIPT",
        "Failed to display Jupyter widget of type. If you are reading this message in the Jupyter notebook or lab it may mean that the widgets JavaScript is still loading",
        "If this message persists it likely means that the widgets JavaScript library is either not installed or not enabled, see the documentation for setup instructions",
        "If you are reading this message in another frontend, for example a static rendering or viewer, it may mean that your frontend does not currently support widgets",
        "open this THING in another|different|modern browser|viewer that supports SCRIPT",
        "noscript",
        "SCRIPT off|disabled|blocked|required|needed",
        "ENABLE SCRIPT",
        "without SCRIPT this THING cannot|not be FETCH",
        "this THING is|are interactive|dynamic and needs|requires SCRIPT",
        "ENABLE it in your browser settings|preferences and reload|refresh",
        "the THING needs|requires a browser with SCRIPT",
        "SCRIPT are|is not allowed|permitted|running|supported|available here",
        "this THING can only be FETCH with SCRIPT",
        "aktivieren Sie JavaScript in Ihrem Browser", "JavaScript muss aktiviert sein|werden", "Diese Seite benötigt|erfordert JavaScript",
        "veuillez activer JavaScript pour continuer", "activer JavaScript dans votre navigateur", "cette|ce page|site nécessite JavaScript",
        "habilite|active|activa JavaScript en su|tu navegador", "esta|este página|sitio requiere|necesita JavaScript", "включите JavaScript в браузере", "эта страница требует JavaScript",
        "Bitte aktivieren|erlauben Sie JavaScript, um diese Seite|Ausgabe|Anwendung zu sehen|nutzen|verwenden|sehen",
        "JavaScript ist in Ihrem Browser deaktiviert",
        "Veuillez|Activez activer JavaScript pour afficher|utiliser|continuer cette|ce page|contenu|site|application",
        "JavaScript est désactivé dans votre navigateur",
        "Active|Habilite|Debe habilitar JavaScript para ver|usar|continuar esta|este página|contenido|aplicación|sitio|cuaderno",
        "JavaScript está deshabilitado|desactivado en su|tu navegador",
        "Attiva|Abilita JavaScript per visualizzare|usare|continuare questa|questo pagina|sito|applicazione|contenuto",
        "Ative|Habilite o JavaScript para ver|usar|continuar esta|este página|site|aplicação|conteúdo",
        "Включите|Для JavaScript чтобы просмотра|просмотреть|продолжить страницу|приложение включите необходимо",
        "请启用 JavaScript 以查看此内容", "您的浏览器未启用 JavaScript", "このページを表示するには JavaScript を有効にしてください", "JavaScript が無効になっています", "JavaScript를 활성화하세요",
    ],
}

#: The usual passages of filler Latin, all of whose words count as filler.
LATIN = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut
aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui
officia deserunt mollit anim id est laborum sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore
veritatis et quasi architecto beatae vitae dicta sunt explicabo nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit sed quia consequuntur magni dolores eos qui ratione
voluptatem sequi nesciunt neque porro quisquam est qui dolorem ipsum quia dolor sit amet consectetur adipisci velit sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam
quaerat voluptatem vestibulum ante primis in faucibus orci luctus et ultrices posuere cubilia curae pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas
maecenas donec vivamus phasellus quisque curabitur integer praesent nullam suspendisse potenti etiam fusce aenean mauris cras proin nunc in hac habitasse platea dictumst cum sociis natoque penatibus
et magnis dis parturient montes nascetur ridiculus mus class aptent taciti sociosqu ad litora torquent per conubia nostra inceptos himenaeos
"""
