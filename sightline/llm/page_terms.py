"""Words by which template residue and the messages of failed pages are told (problem 5).

Fixed values: single words and stems, no sentences, in lower case; a hyphen at the end stands for any further letters.
"""

from __future__ import annotations

import re
from http import HTTPStatus

# What a message is about, by concept.
TOPICS = {
    "page": """page pages site website webpage store shop url link address content product products article item resource file document listing
        seite webseite inhalt produkt artikel datei adresse contenu produit fichier article sitio página contenido producto archivo sito pagina contenuto prodotto
        conteúdo produto страниц- сайт- товар- strona strony produktu 페이지- 사이트- 상품- 제품-""",
    "server": """server servers service services dienste dienstes servidores servizi serviços usługi gateway request requests connection system systems upstream backend application app database anfrage dienst anwendung verbindung
        serveur requête connexion servidor servicio solicitud conexión aplicación servizio richiesta connessione applicazione serviço solicitação сервер- сервис- запрос- serwer usługa 서버- 서비스- 요청-""",
    "access": "access permission permissions authorization zugriff zugang berechtigung accès autorisation acceso permiso accesso permesso acesso доступ- toegang dostęp 접근- 액세스- 권한-",
    "script": "javascript java-script script scripts js browser navegador navigateur скрипты 자바스크립트- 스크립트-",
    "human": "robot robots bot bots human captcha traffic person roboter mensch humain humano umano robô робот roboten robotem 로봇-",
    "session": "session sessions login sitzung anmeldung sesión sessione sessão сессия sessie sesja 세션-",
    "fault": "error errors fehler fehlers erreurs errores errori erros erreur errore erro problem problème problema ошибк- fout błąd exception failure 오류- 에러-",
}
# What it says of that.
STATES = {
    "missing": "unavailable introuvable nonexistent gone offline missing broken deleted removed lost closed withdrawn vanished expired discontinued dead inexistent- indisponib- indisponív- inaccessib- inacces- unreachable inaccesible gelöscht entfernt supprim- eliminad- removid- rimoss- удал- недоступ- verwijderd usunięt-",
    "found": """found find exist exists existing respond responding working work works loading accessible gibt funktioniert antwortet répond fonctionne funciona responde funziona risponde werkt działa работает отвечает verfügbare available reach reached reachable load loaded supported support seem online authorized authorised allowed permitted display displayed gefunden geladen geöffnet angezeigt existiert verfügbar erreichbar trouvée trouvé trouver existe disponible
        encontramos encontrado encontrada encontró encuentra trovata trovato trovare esiste disponibile encontrei disponível найден- существует доступна gevonden bestaat beschikbaar znaleziono istnieje 찾을 존재하- 사용할""",
    "denied": """denied forbidden blocked refused restricted unauthorized unauthorised prohibited banned suspended disallowed invalid insufficient abgelehnt verboten refusée interdite bloquée denegada restringid- vietata negata proibid- negad- bloquead- verboden verweigert gesperrt blockiert untersagt refusé interdit bloqué denegado bloqueado bloqueada prohibido negado negato bloccato vietato
        запрещ- заблокирован- отказано geweigerd geblokkeerd odmowa zabroniony 거부- 차단-""",
    "expired": "expired timeout abgelaufen expirée expiré caducado caducada expirado expirada scaduta scaduto истек- verlopen wygasła 만료- timed",
    "broken": """wrong failed crashed occurred completed unexpected happened reset interrupted aborted lost broke corrupt corrupted fatal critical internal unusual unable refused schiefgelaufen schief aufgetreten interner unerwarteter unerwartet- produit inattendu- survenu- inesperad- intern- imprevist- неизвестн- onverwacht- nieoczekiwan- survenue produite interne ocurrido producido interno
        verificato imprevisto ocorreu произошла внутренняя opgetreden wystąpił bad 발생-""",
    "fell": "down",
    "down": "maintenance wartung- mantenimiento manutenção manutenzione onderhoud техническ- обслуживани- konserwacja 점검-",
    "demand": """enable enabled activate allow require requires required need needs must disabled turn turned switch switched active off aktivieren aktiviert erlauben zulassen benötigt allowed erfordert einschalten deaktiviert ausgeschaltet
        activez activer nécessite besoin désactivé active activar habilite habilitar necesita requiere desactivado attiva attivare abilita abilitare disattivato ative habilitado включите отключен- schakel inschakelen uitgeschakeld włącz wymaga 활성화- 켜- 필요-""",
    "check": "confirm verify verifying prove checking check complete completing solve solving bestätigen prüfen überprüfen confirmez vérifiez confirme verifique conferma verifica проверка подтвердите bevestig potwierdź 확인-",
    "many": "many overloaded busy viele trop demasiadas troppe muitas много",
}
#: Words that turn a state round.
NOT = "not no cannot can't couldn't doesn't don't isn't never without unable nothing nicht kein keine nie ne n' pas aucune aucun non sin não не нет нельзя niet geen nie brak 없- 않-"
# Words that any message has, about nothing in particular.
COMMON = """
    a an the this that these it its we i you your our us my is are was be been being has have had do does did can could may might looks look like below above action actions following undergoing scheduled planned progress another different content want wanted help team us them all into try new will would should at of on in to for from by with as or and but so if because than persists persist continues again anymore out
    please sorry oops hmm uh ohh oh ooops whoops apologies pardon interruption thank thanks again later soon back come return try retry wait reload refresh go start home few minutes minute moment moments seconds while right now just
    temporarily currently shortly briefly longer any more side end here there before after continue view see open run use using access visit looking requested request made encountered processing answer waiting valid invalid
    slow seems something everything went contact support administrator operator attention cookies ip account network networks followed clicked typed entered mistyped outdated old moved required webmaster owner team reference code id ray trace incident details number status message sign log seem taking too time first
    security special unusual detected load due under up well about review choices settings details one instead other properly correctly still yet
    die der das den dem ein eine einen diese dieser dieses wir ihr ihre ihnen sie es ist sind war wurde wird werden hat haben leider bitte später erneut versuchen zurück noch mal gerade durch dass ob um zu im in auf für gibt ups hoppla mal uns dass man vielleicht mit und oder von gesuchte angeforderte mehr zurzeit derzeit nun jetzt warten
    ist bei kurz momentan vorübergehend dafür etwas anzuzeigen anzeigen nutzen laden führen gerade kommen
    le la les l un une des du oups temporairement actuellement momentanément produite nouveau page de ce cet cette c d votre vous nous est sont était été a ont veuillez désolé réessayer réessayez plus tard revenir merci en cours pour par sur que qui n s à êtes avez au pas il y demandée recherchée afficher
    el la los las lo un una unos de del al su sus usted se es está están estamos ha han sido por favor sentimos fue era vuelva vuelve ups actualmente momento temporalmente intente intentarlo más tarde para con que en y o esta este solicitada ver
    il i gli uno una dello ops momentaneamente attualmente al momento della di da questa questo è sono stato stata si prego spiacenti riprova riprovare più tardi per che non la le richiesta cercata
    o os as um uma do da no ops no momento temporariamente na esta este é está foi por desculpe tente novamente mais tarde para que não solicitada
    de het een deze dit oeps er is momenteel tijdelijk is zijn was wordt werd u uw wij helaas sorry probeer later opnieuw voor om te en of van op dat
    и в на по к с для что это эта этот вы ваш мы к сожалению пожалуйста позже попробуйте снова ведутся работы
    ta ten to jest są nie proszę przepraszamy spróbuj ponownie później dla z w na do
    죄송합니다 요청하신 수 다시 시도해 주세요 나중에 해주세요 하세요 되었습니다 했습니다 합니다 있습니다
"""
#: Signs that a text writes about such a thing.
ABOUT = """
    when where whether why how which earlier older releases release version versions build builds fix fixes fixed fixing corrects corrected changelog messages named called shows showed prints printed says said wrote writes reports reported
    wenn falls weshalb warum version behoben korrigiert meldungen quand pourquoi corrige corrigé version cuando cuándo corrige corregido versión quando corretto versione когда исправлен версии
"""
# Japanese and Chinese: the topics, states and other words, which are looked for within the text.
HAN_PAIRS = (
    ("ページ お探し サイト 商品 ファイル 页面 网页 網頁 頁面 页 内容 商品 链接", "見つかりません 存在しません 表示できません 削除 ありません 利用できません 找不到 未找到 不存在 无法显示 已删除 無法"),
    ("サーバー サービス サイト システム 接続 服务器 服務器 系统 系統 服务 网站 连接 请求", "エラー メンテナンス 停止 混雑 タイムアウト 错误 錯誤 维护 維護 超时 不可用 繁忙 失败 中断"),
    ("アクセス 権限 访问 存取 权限", "拒否 禁止 制限 ブロック ありません 拒绝 拒絕 没有 受限"),
    ("スクリプト javascript ブラウザ 脚本 浏览器", "有効 無効 オン オフ 必要 対応 启用 禁用 開啟 开启 需要 关闭 不支持"),
    ("ロボット 人間 captcha トラフィック 机器人 真人 验证码", "確認 証明 認証 通常 验证 确认 异常"),
    ("セッション ログイン 会话 登录", "切れ 期限 終了 过期 超时 失效"),
    ("エラー 問題 错误 問題", "発生 起き 发生 出现"),
    ("ただいま 現在 正在", "メンテナンス 维护 維護"),
)
HAN_COMMON = "申し訳 誠に 恐れ入り 現在 時間 後 再度 お試し 下さい 表示 指定 要求 一時的 ご 内部 入力 当 您 的 了 请 請 抱歉 对不起 稍后 重试 再试 后 无法 本 该 此 我们 正在 进行 暂时 以 查看 继续 是 已 未 被 内部"

#: What somebody's words should have replaced.
FILLER_TOPICS = """
    headline heading title subtitle text texts description content copy paragraph caption image name product label lorem body placeholder platzhalter platzhaltertext mustertext beispieltext segnaposto заглушка voorbeeldtekst
    titel überschrift beschreibung inhalt text blindtext titre texte contenu légende título texto contenido descripción titolo testo contenuto descrizione título conteúdo descrição заголовок текст tekst tytuł titel
"""
FILLER_STATES = """
    here placeholder sample dummy example demo insert replace lorem ipsum coming tbd tba todo fixme follow hier platzhalter platzhaltertext blindtext mustertext beispieltext ersetzen einfügen ici remplacement factice exemple remplacer
    modifier insérer aquí ejemplo relleno prueba sustituir insertar qui esempio segnaposto inserire sostituire aqui exemplo substituir пример здесь заглушка wstaw przykładowy voorbeeldtekst
"""
FILLER_COMMON = """
    your the a an some any goes go comes soon add enter put with is are this that of to for and or be follow announced defined replaced provided supplied added written later pending determined done it please steht kommt folgt ein eine ihr ihre bitte noch der die das mit austauschen
    un une le la de du des votre à d el su una por favor il vostro per o seu é это ваш
"""
HAN_FILLERS = (("テキスト 文章 タイトル 見出し 説明 文字 文本 标题 内容 標題", "ダミー サンプル ここに 仮 示例 占位 此处 这里 測試 测试"),)

#: Standard filler, by whose words' beginnings pseudo-Latin is told.
STANDARD_FILLER = """
    lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo
    consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
"""
#: Rows of a keyboard, over which fingers run.
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop")

#: The reason phrases of HTTP's error codes, from the standard.
REASONS = {s.value: s.phrase.lower() for s in HTTPStatus if s.value >= 400}


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())


def matcher(text: str) -> re.Pattern:
    """A pattern for one of these words; a hyphen at the end stands for any further letters."""
    stems = sorted({w for w in text.split()}, key=len, reverse=True)
    return re.compile("(?:" + "|".join(re.escape(w.rstrip("-")) + (r"\w*" if w.endswith("-") else "") for w in stems) + r")\Z")
