"""Broken prompt–response pairs: a multi-label linear classifier on hashed n-grams and features of the pair.

Nobody labels pairs, so the classifier learns from sound pairs that are broken on purpose: cut off, replaced by the
question, by an answer in another language, by a refusal or by a placeholder. Exact observations (how an answer ends,
whether it is the question, which language it is in) are features beside the n-grams; each class has a threshold
calibrated on broken versions of pairs, and with refusals, that training didn't see. The classifier alone decides.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.payload import case_key_or_derived
from scorelake.storage import staged

CLASSES = ["empty", "truncated", "refusal", "copied_question", "wrong_language"]
#: Languages told apart by n-grams, and those that their script tells.
LATIN = ["en", "de", "fr", "es", "it", "pt", "nl", "sv", "da", "pl", "cs", "ro", "tr", "fi", "hu", "id", "vi"]
CODES = [*LATIN, "ru", "zh", "ja", "ko", "ar", "el", "hi", "th"]

#: The classifier is fitted on at most so many pairs, those whose key hashes lowest (bound of the training sample).
SAMPLE = 3000
BITS = 15  # hashed n-grams: 2**BITS weights for each output
NGRAMS = (2, 4)

#: Frequent function words by language (fixed values).
FUNCTION_WORDS = {
    "en": "the of and is in to that which are for it was with how what who should there were this from has have but not an on by because first they".split(),
    "de": "der die das und ist in den von zu mit wie wer wird auf sich nicht auch eine ein im es für wenn dem bei aus nach soll sind des obwohl einem wurde man".split(),
    "fr": "le la les et est une un des du dans que qui pour pas avec sur ce il en au aux sont par quel comment ont été si on même ne l'on".split(),
    "es": "el la los las y es de una un en que se con por para del al no su como cuántos qué quién cuál fue son más si otra lo hay porque aunque esta".split(),
    "it": "il lo gli e è di una un che per con del della sono non si come più nel alla dal questo anche perché quando".split(),
    "pt": "o os as e é de uma um que para com do da são não se como mais no na pelo isso também porque quando foi".split(),
    "nl": "de het een en van is dat op te in met voor niet zijn aan er maar om ook als bij wordt deze naar".split(),
    "ru": "и в не на что с по это как из у для так но же от до при если чтобы он она они который его или все потому".split(),
}
#: Names of languages in requests for an answer in one (fixed values).
LANGUAGE_NAMES = {
    "en": "english englisch englischer anglais inglés ingles inglese inglês engels английском по-английски английский 英文 英语 英語 영어 الإنجليزية αγγλικά अंग्रेज़ी อังกฤษ".split(),
    "de": "german deutsch deutscher allemand alemán aleman tedesco alemão duits немецком по-немецки немецкий 德文 德语 ドイツ語 독일어".split(),
    "fr": "french französisch französischer français francais francés frances francese francês frans французском по-французски французский 法文 法语 フランス語 프랑스어".split(),
    "es": "spanish spanisch spanischer espagnol español espanol spagnolo espanhol spaans испанском по-испански испанский 西班牙文 西班牙语 スペイン語 스페인어".split(),
    "it": "italian italienisch italien italiano itálico итальянском по-итальянски 意大利文 意大利语 イタリア語".split(),
    "pt": "portuguese portugiesisch portugais portugués português португальском по-португальски 葡萄牙文 葡萄牙语".split(),
    "nl": "dutch niederländisch néerlandais holandés нидерландском по-нидерландски 荷兰文 荷兰语".split(),
    "ru": "russian russisch russischer russe ruso russo русском по-русски русский 俄文 俄语 ロシア語 러시아어".split(),
    "zh": "chinese chinesisch chinesischer chinois chino cinese chinês китайском по-китайски китайский 中文 汉语 漢語 中国語 중국어".split(),
    "ja": "japanese japanisch japonais japonés giapponese японском по-японски 日文 日语 日本語 일본어".split(),
    "ko": "korean koreanisch coréen coreano корейском по-корейски 韩文 韩语 韓国語 한국어".split(),
    "ar": "arabic arabisch arabe árabe арабском по-арабски 阿拉伯文 阿拉伯语 العربية".split(),
    "el": "greek griechisch grec griego греческом по-гречески 希腊文 希腊语 ελληνικά".split(),
    "hi": "hindi хинди 印地语 हिंदी हिन्दी".split(),
    "th": "thai thailändisch thaï tailandés тайском 泰文 泰语 ไทย".split(),
}
#: Words that ask for an answer (fixed values).
_ASKS = r"answer|respond|reply|write|antwort\w*|schreib\w*|répon\w*|repond\w*|écri\w*|respond\w*|contest\w*|escrib\w*|rispond\w*|ответ\w*|напиши\w*|用|以|で答|로 답"
#: Refusals for training, by language (fixed values).
REFUSALS = {
    "en": "I'm sorry, but I can't help with that.|I cannot assist with this request.|I must decline to answer this question.|As a language model, I am not able to give an answer here.|I won't be answering this, as it goes against my guidelines.|This isn't something I can weigh in on, so I'd rather not say.|I'd prefer to leave that one alone. Is there anything else you need?|Sorry, that falls outside of what I'm permitted to discuss.|Unfortunately I'm unable to comply with this one. Please ask someone qualified.|I appreciate the question, yet responding to it would not be appropriate for me.|I am unable to provide an answer to that.|I can't discuss this topic.|It would be against my policy to answer.|I have to refuse this request.|I apologize, but I cannot fulfil that request.".split("|"),
    "de": "Es tut mir leid, aber dabei kann ich nicht helfen.|Diese Anfrage darf ich leider nicht beantworten.|Als Sprachmodell möchte ich mich dazu nicht äußern.|Dazu gebe ich keine Auskunft. Bitte wenden Sie sich an eine Fachperson.|Ich lehne es ab, hierauf zu antworten.|Leider kann ich diese Frage nicht beantworten.|Dazu darf ich nichts sagen.|Ich kann Ihnen bei dieser Bitte nicht weiterhelfen.".split("|"),
    "fr": "Je suis désolé, mais je ne peux pas vous aider.|Il m'est impossible de répondre à cette demande.|Je refuse de traiter cette question, merci de votre compréhension.|En tant que modèle de langue, je préfère ne pas me prononcer.|Je ne suis pas autorisé à répondre à cela.|Désolé, je ne peux pas répondre à cette question.".split("|"),
    "es": "Lo siento, pero no puedo ayudarte con eso.|No me está permitido responder a esta solicitud.|Debo negarme a contestar esta pregunta.|Como modelo de lenguaje, prefiero no pronunciarme.|No puedo responder a esta pregunta.|Lamento no poder ayudar con esta petición.".split("|"),
    "ru": "Извините, но я не могу с этим помочь.|Как языковая модель, я не стану это комментировать.|Я вынужден отказаться от ответа на этот вопрос.|К сожалению, я не могу ответить на этот запрос.|Мне не разрешено отвечать на такие вопросы.".split("|"),
    "zh": "很抱歉，我无法提供帮助。|作为语言模型，我不能回答这个问题。|这个请求超出了我可以讨论的范围，请见谅。|对不起，我不能协助这个请求。|我不便回答这个问题。".split("|"),
    "it": "Mi dispiace, ma non posso aiutarti con questo.|Come modello linguistico, preferisco non rispondere.|Non mi è consentito rispondere a questa richiesta.|Devo rifiutare questa domanda.".split("|"),
    "pt": "Desculpe, mas não posso ajudar com isso.|Não me é permitido responder a este pedido.|Como modelo de linguagem, prefiro não responder.|Tenho de recusar esta pergunta.".split("|"),
    "nl": "Het spijt me, maar daar kan ik niet bij helpen.|Die vraag mag ik niet beantwoorden.|Als taalmodel geef ik hier geen antwoord op.|Ik moet dit verzoek weigeren.".split("|"),
    "sv": "Jag är ledsen, men det kan jag inte hjälpa till med.|Den frågan får jag inte svara på.|Som språkmodell vill jag inte uttala mig om detta.".split("|"),
    "pl": "Przykro mi, ale nie mogę w tym pomóc.|Nie wolno mi odpowiedzieć na to pytanie.|Jako model językowy wolę się na ten temat nie wypowiadać.".split("|"),
    "tr": "Üzgünüm, ama bu konuda yardımcı olamam.|Bu soruyu yanıtlamama izin verilmiyor.|Bir dil modeli olarak bu konuda yorum yapamam.".split("|"),
    "ja": "申し訳ありませんが、お手伝いできません。|その質問にはお答えできません。|言語モデルとして、この件にはコメントできません。|ご要望にはお応えしかねます。".split("|"),
    "ko": "죄송하지만 도와드릴 수 없습니다.|이 질문에는 답변할 수 없습니다.|언어 모델로서 이에 대해 말씀드릴 수 없습니다.|요청을 거절해야 합니다.".split("|"),
    "ar": "آسف، لا يمكنني المساعدة في ذلك.|لا يمكنني الإجابة على هذا السؤال.|بصفتي نموذجًا لغويًا، أفضل عدم التعليق.|يجب أن أرفض هذا الطلب.".split("|"),
    "el": "Λυπάμαι, αλλά δεν μπορώ να βοηθήσω με αυτό.|Δεν μου επιτρέπεται να απαντήσω σε αυτή την ερώτηση.|Ως γλωσσικό μοντέλο προτιμώ να μην απαντήσω.".split("|"),
    "hi": "क्षमा करें, मैं इसमें मदद नहीं कर सकता।|मुझे इस प्रश्न का उत्तर देने की अनुमति नहीं है।|एक भाषा मॉडल के रूप में मैं इस पर टिप्पणी नहीं कर सकता।".split("|"),
    "th": "ขออภัย ฉันไม่สามารถช่วยเรื่องนี้ได้|ฉันไม่ได้รับอนุญาตให้ตอบคำถามนี้|ในฐานะโมเดลภาษา ฉันขอไม่แสดงความเห็น".split("|"),
}
#: Plain prose by language, for languages and defects that the data don't show (fixed values; the same four sentences).
PROSE = {
    "en": "The city lies on the river and has about two million people.|It was founded long ago, and most of its visitors come in summer.|You can take the train from the station to the old town.|Nobody knows why the first attempt failed, but the second one worked.",
    "de": "Die Stadt liegt am Fluss und hat etwa zwei Millionen Einwohner.|Sie wurde vor langer Zeit gegründet, und die meisten Besucher kommen im Sommer.|Man kann mit dem Zug vom Bahnhof in die Altstadt fahren.|Niemand weiß, warum der erste Versuch scheiterte, aber der zweite gelang.",
    "fr": "La ville se trouve au bord du fleuve et compte environ deux millions d'habitants.|Elle a été fondée il y a longtemps, et la plupart des visiteurs viennent en été.|On peut prendre le train de la gare jusqu'à la vieille ville.|Personne ne sait pourquoi le premier essai a échoué, mais le deuxième a réussi.",
    "es": "La ciudad está junto al río y tiene unos dos millones de habitantes.|Fue fundada hace mucho tiempo, y la mayoría de los visitantes llegan en verano.|Se puede tomar el tren desde la estación hasta el casco antiguo.|Nadie sabe por qué falló el primer intento, pero el segundo funcionó.",
    "it": "La città si trova sul fiume e ha circa due milioni di abitanti.|Fu fondata molto tempo fa e la maggior parte dei visitatori arriva in estate.|Si può prendere il treno dalla stazione fino al centro storico.|Nessuno sa perché il primo tentativo sia fallito, ma il secondo ha funzionato.",
    "pt": "A cidade fica junto ao rio e tem cerca de dois milhões de habitantes.|Foi fundada há muito tempo, e a maioria dos visitantes chega no verão.|Pode-se apanhar o comboio da estação até à cidade velha.|Ninguém sabe por que a primeira tentativa falhou, mas a segunda funcionou.",
    "nl": "De stad ligt aan de rivier en heeft ongeveer twee miljoen inwoners.|Ze werd lang geleden gesticht en de meeste bezoekers komen in de zomer.|Je kunt met de trein van het station naar de oude stad gaan.|Niemand weet waarom de eerste poging mislukte, maar de tweede lukte wel.",
    "sv": "Staden ligger vid floden och har ungefär två miljoner invånare.|Den grundades för länge sedan och de flesta besökare kommer på sommaren.|Man kan ta tåget från stationen till gamla stan.|Ingen vet varför det första försöket misslyckades, men det andra fungerade.",
    "da": "Byen ligger ved floden og har omkring to millioner indbyggere.|Den blev grundlagt for længe siden, og de fleste besøgende kommer om sommeren.|Man kan tage toget fra stationen til den gamle by.|Ingen ved, hvorfor det første forsøg mislykkedes, men det andet lykkedes.",
    "pl": "Miasto leży nad rzeką i ma około dwóch milionów mieszkańców.|Zostało założone dawno temu, a większość gości przyjeżdża latem.|Można pojechać pociągiem z dworca na stare miasto.|Nikt nie wie, dlaczego pierwsza próba się nie udała, ale druga się powiodła.",
    "cs": "Město leží na řece a má asi dva miliony obyvatel.|Bylo založeno velmi dávno a většina návštěvníků přijíždí v létě.|Z nádraží se dá jet vlakem do starého města.|Nikdo neví, proč se první pokus nezdařil, ale druhý se povedl.",
    "ro": "Orașul se află pe malul râului și are aproximativ două milioane de locuitori.|A fost întemeiat cu mult timp în urmă, iar cei mai mulți vizitatori vin vara.|Se poate lua trenul de la gară până în orașul vechi.|Nimeni nu știe de ce prima încercare a eșuat, dar a doua a reușit.",
    "tr": "Şehir nehrin kıyısında yer alır ve yaklaşık iki milyon nüfusu vardır.|Çok uzun zaman önce kurulmuştur ve ziyaretçilerin çoğu yazın gelir.|İstasyondan eski şehre trenle gidebilirsiniz.|İlk denemenin neden başarısız olduğunu kimse bilmiyor, ama ikincisi başarılı oldu.",
    "fi": "Kaupunki sijaitsee joen varrella, ja siellä on noin kaksi miljoonaa asukasta.|Se perustettiin kauan sitten, ja useimmat kävijät tulevat kesällä.|Asemalta pääsee junalla vanhaan kaupunkiin.|Kukaan ei tiedä, miksi ensimmäinen yritys epäonnistui, mutta toinen onnistui.",
    "hu": "A város a folyó partján fekszik, és körülbelül kétmillió lakosa van.|Nagyon régen alapították, és a legtöbb látogató nyáron érkezik.|Az állomásról vonattal lehet eljutni az óvárosba.|Senki sem tudja, miért nem sikerült az első kísérlet, de a második sikerült.",
    "id": "Kota itu terletak di tepi sungai dan memiliki sekitar dua juta penduduk.|Kota ini didirikan sejak lama, dan kebanyakan pengunjung datang pada musim panas.|Anda dapat naik kereta dari stasiun ke kota tua.|Tidak ada yang tahu mengapa percobaan pertama gagal, tetapi yang kedua berhasil.",
    "vi": "Thành phố nằm bên bờ sông và có khoảng hai triệu người.|Nó được thành lập từ rất lâu, và phần lớn du khách đến vào mùa hè.|Bạn có thể đi tàu từ nhà ga đến khu phố cổ.|Không ai biết vì sao lần thử đầu tiên thất bại, nhưng lần thứ hai đã thành công.",
    "ru": "Город стоит на реке, и в нём около двух миллионов жителей.|Он был основан давно, и большинство гостей приезжает летом.|С вокзала можно доехать на поезде до старого города.|Никто не знает, почему первая попытка не удалась, но вторая получилась.",
    "zh": "这座城市位于河边，约有两百万人口。|它建立于很久以前，大多数游客在夏天到来。|可以从车站坐火车去老城。|没有人知道第一次尝试为什么失败，但第二次成功了。",
    "ja": "その都市は川沿いにあり、人口は約二百万人です。|ずっと昔に築かれ、訪れる人の多くは夏に来ます。|駅から旧市街まで電車で行けます。|最初の試みがなぜ失敗したかは誰も知りませんが、二回目はうまくいきました。",
    "ko": "그 도시는 강가에 있으며 인구는 약 이백만 명입니다.|아주 오래전에 세워졌고 방문객 대부분은 여름에 옵니다.|역에서 기차를 타고 구시가지로 갈 수 있습니다.|첫 시도가 왜 실패했는지는 아무도 모르지만 두 번째는 성공했습니다.",
    "ar": "تقع المدينة على النهر ويسكنها نحو مليوني نسمة.|أُسست منذ زمن بعيد ويأتي معظم الزوار في الصيف.|يمكنك أن تستقل القطار من المحطة إلى المدينة القديمة.|لا أحد يعرف لماذا فشلت المحاولة الأولى لكن الثانية نجحت.",
    "el": "Η πόλη βρίσκεται δίπλα στο ποτάμι και έχει περίπου δύο εκατομμύρια κατοίκους.|Ιδρύθηκε πριν από πολύ καιρό και οι περισσότεροι επισκέπτες έρχονται το καλοκαίρι.|Μπορείτε να πάρετε το τρένο από τον σταθμό ως την παλιά πόλη.|Κανείς δεν ξέρει γιατί απέτυχε η πρώτη προσπάθεια, αλλά η δεύτερη πέτυχε.",
    "hi": "यह शहर नदी के किनारे है और इसमें लगभग बीस लाख लोग रहते हैं।|इसकी स्थापना बहुत पहले हुई थी और अधिकतर लोग गर्मियों में आते हैं।|स्टेशन से पुराने शहर तक ट्रेन से जा सकते हैं।|कोई नहीं जानता कि पहला प्रयास क्यों असफल हुआ, लेकिन दूसरा सफल रहा।",
    "th": "เมืองนี้ตั้งอยู่ริมแม่น้ำและมีประชากรราวสองล้านคน|เมืองนี้ก่อตั้งมานานแล้วและนักท่องเที่ยวส่วนใหญ่มาในฤดูร้อน|คุณนั่งรถไฟจากสถานีไปเมืองเก่าได้|ไม่มีใครรู้ว่าทำไมครั้งแรกจึงล้มเหลว แต่ครั้งที่สองสำเร็จ",
}
#: Refusals that name what they refuse, for training (fixed values).
REFUSALS_ABOUT = {
    "en": "I'm sorry, but I can't tell you anything about {}.|I cannot help with questions about {}.|I won't discuss {}, as that is against my guidelines.|Unfortunately I am not able to answer \"{}\".|I must decline to say anything on {}.".split("|"),
    "de": "Leider kann ich Ihnen zu {} nichts sagen.|Es tut mir leid, über {} darf ich keine Auskunft geben.|Ich möchte mich zu {} nicht äußern.|Fragen zu {} beantworte ich nicht.".split("|"),
    "fr": "Je suis désolé, mais je ne peux rien dire sur {}.|Je ne suis pas en mesure de répondre à propos de {}.|Je préfère ne pas parler de {}.".split("|"),
    "es": "Lo siento, pero no puedo decirte nada sobre {}.|No puedo ayudar con preguntas sobre {}.|Prefiero no hablar de {}.".split("|"),
    "ru": "К сожалению, я не могу ничего сказать о {}.|Извините, я не отвечаю на вопросы про {}.|Я не стану обсуждать {}.".split("|"),
    "zh": "很抱歉，我无法回答关于{}的问题。|对不起，我不能谈论{}。|我不便透露{}的任何信息。".split("|"),
    "it": "Mi dispiace, non posso dire nulla su {}.|Preferisco non parlare di {}.".split("|"),
    "pt": "Lamento, mas não posso dizer nada sobre {}.|Prefiro não falar de {}.".split("|"),
    "ja": "申し訳ありませんが、{}についてはお答えできません。|{}に関する質問には回答を控えます。".split("|"),
    "ko": "죄송하지만 {}에 대해서는 답변할 수 없습니다.|{}에 관한 질문에는 답하지 않겠습니다.".split("|"),
}
#: Placeholders for training (fixed values).
PLACEHOLDERS = ["", " ", "\n\n", "...", "-", "—", "N/A", "[]", "{}", "(no answer)", "[empty response]", "Answer:", "**Answer:** ", "答案：", "Respuesta:\n", "Antwort: ", "Réponse :", "Ответ:", "<answer></answer>", "```\n```", "Final answer: \\boxed{}", "\u200b", "null", "None"]
#: Words before a question that is given back, for training (fixed values).
LEADS = ["You asked:", "The question is:", "Die Frage lautet:", "La question est :", "La pregunta es:", "Вопрос такой:", "问题是："]
#: Words that name an answer without giving one (fixed values).
_LABELS = re.compile(
    r"\b(?:the|final|answer|response|output|result|reply|empty|no|none|null|nil|nan|blank|n\s*/?\s*a|tbd|todo|undefined|placeholder|antwort|endgültige|ergebnis|keine|leer|respuesta|final|sin|vacía|vacío|resultado|réponse|finale|résultat|pas|de|aucune|vide|ответ|нет|итоговый|результат|пусто|risposta|resposta|boxed|text|insert|here|your)\b"
    r"|答案|回答|无|空|没有|最终|结果|答え|답변|답|الإجابة|جواب|απάντηση|उत्तर|คำตอบ",
    re.I,
)
_TAGS = re.compile(r"<[^<>]{0,80}>|\\boxed|```[a-z]*|[\u200b-\u200f\u2060\ufeff]")
_BLANKS, _FILLED = re.compile(r"\s+|[\W_]"), re.compile(r"[^\W_]+")
_CUT_MARK = re.compile(r"(?:…|\.\.\.|\[(?:truncated|max tokens reached|cut off|length limit|output truncated|…|\.\.\.)\]|\(truncated\)|<(?:truncated|cut)>|\[continued\])\s*$", re.I)
_SPECIFIC = re.compile(r"\d+|(?<![^\W\d_])[^\W\d_]++(?:-[^\W\d_]++)+|(?<![.!?¿¡\s\w])\b[A-Z][a-z]{2,}|(?<=\w )[A-Z][a-z]{2,}", re.U)
_VALUE = re.compile(r"\d|(?<![^\W\d_])[^\W\d_]++-[^\W\d_]+")
_TOKEN = re.compile(r"\d+|[a-z\u00df-\u024f]+(?:-[a-z\u00df-\u024f]+)*|[\u0430-\u04ff]+(?:-[\u0430-\u04ff]+)*")
_QUOTED = re.compile("[\"“„«「][^\"”“»」]*(?:[\"”“»」]|$)")
_DIGITS = re.compile(r"\d+")
_SPACES = re.compile(r"\s+")
_LEAD = re.compile(r"[^:：.!?。！？\d]{1,40}[:：]\W*")
_ENDS = frozenset(".!?。！？｡؟।…」』”»")
_CLOSERS = "\"'”’»)]}）」』】*`_ \t\n"


def unwrapped(text: str, depth: int = 2) -> tuple[str, bool]:
    """(the answer inside JSON, whether the text begins as JSON but breaks off)."""
    head = text.lstrip()
    if head[:1] not in ("{", '"') or depth == 0:
        return text, False
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        if re.match(r'\{\s*"\w+"\s*:', head):
            inner = re.match(r'\{\s*"\w+"\s*:\s*"?', head)
            return head[inner.end() :] if inner else head, True
        return text, False
    if isinstance(value, dict):
        held = next((value[k] for k in ("answer", "response", "output", "text", "content") if k in value), None)
        if held is None:
            return ("" if not value else text), False
        value = held
    if value is None or value == [] or value == {}:
        return "", False
    return unwrapped(value, depth - 1) if isinstance(value, str) else (json.dumps(value, ensure_ascii=False), False)


def normal(text: str) -> str:
    return " ".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold().split())


def bare(text: str) -> str:
    """The first word of a text that is neither markup, a label nor a placeholder; empty if it answers nothing. Whatever
    stands before it is read, however long."""
    at = 0
    while at < len(text):
        skipped = _TAGS.match(text, at) or _LABELS.match(text, at) or _BLANKS.match(text, at)
        if skipped is None:
            return _FILLED.match(text, at)[0]
        at = skipped.end()
    return ""


@lru_cache(50_000)
def question_text(raw: str | None) -> str:
    """The question in an input, whatever its JSON shape: a string, question, prompt, instruction, or the last message of
    a user; several text members are joined."""
    if not raw:
        return ""
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return raw
    if isinstance(value, str):
        return question_text(value) if value[:1] in ('{', '"') else value
    if isinstance(value, dict):
        for key in ("messages", "conversation", "turns"):
            if isinstance(value.get(key), list):
                asked = [m.get("content") for m in value[key] if isinstance(m, dict) and m.get("role", "user") == "user"]
                return str(asked[-1]) if asked and asked[-1] is not None else ""
        held = [value[k] for k in ("question", "prompt", "instruction", "query", "text", "input") if isinstance(value.get(k), str) and value[k].strip()]
        return "\n".join(dict.fromkeys(held)) if held else ""
    return raw


_NAMES = {name: code for code, names in LANGUAGE_NAMES.items() for name in names}
_WANTED = re.compile(r"(?:%s)[^.!?。！？\n]*?(%s)" % (_ASKS, "|".join(sorted(map(re.escape, _NAMES), key=len, reverse=True))), re.I)
_REQUEST = re.compile(r"[^.!?。！？\n]*(?:%s)[^.!?。！？\n]*?(?:%s)[^.!?。！？\n]*[.!?。！？]?" % (_ASKS, "|".join(sorted(map(re.escape, _NAMES), key=len, reverse=True))), re.I)


def script_language(text: str) -> str | None:
    """The language that the script alone tells, if most letters are of it; "" for Latin or Cyrillic, None without letters."""
    if not text or max(text) < "\u0250":
        return "" if _LETTERS.search(text) else None
    n = {code: scale * sum(map(len, pattern.findall(text))) for code, (pattern, scale) in _SCRIPTS.items()}
    top = max(n, key=n.get)
    return top if n[top] else None


#: Letters of a script (fixed ranges), and how much one counts against letters of others: names and identifiers in Latin
#: letters stand in texts of any language, kana tell Japanese from Chinese.
_SCRIPTS = {
    "": (re.compile("[A-Za-z\u00c0-\u024f]+"), 1 / 3), "zh": (re.compile("[\u4e00-\u9fff]+"), 2), "ja": (re.compile("[\u3040-\u30ff]+"), 6), "ko": (re.compile("[\uac00-\ud7a3]+"), 2),
    "ru": (re.compile("[\u0400-\u052f]+"), 1), "ar": (re.compile("[\u0600-\u06ff]+"), 1), "el": (re.compile("[\u0370-\u03ff]+"), 1), "hi": (re.compile("[\u0900-\u097f]+"), 1), "th": (re.compile("[\u0e00-\u0e7f]+"), 1),
}
_LETTERS = re.compile(r"[^\W\d_]+")


_WORDS = {w: [c for c, ws in FUNCTION_WORDS.items() if w in ws] for ws_ in FUNCTION_WORDS.values() for w in ws_}


def surely(text: str) -> str | None:
    """The language by script and function words, if they leave no doubt (labels for training)."""
    by = script_language(text)
    if by != "":
        return by if by != "ru" or re.search(r"[ыэъё]|\b(?:и|на|не|что|по)\b", text) else None
    hits: dict[str, int] = {}
    for word in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", text.lower()):
        for code in _WORDS.get(word, ()):
            hits[code] = hits.get(code, 0) + 1
    order = sorted(hits.items(), key=lambda x: -x[1])
    return order[0][0] if order and order[0][1] >= 2 and (len(order) == 1 or order[0][1] >= 2 * order[1][1]) else None


def _hashed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: (hash of each character n-gram, number of its text), vectorised over whole texts. Texts have a mark at
    both ends, so grams see beginnings and ends."""
    joined = [f"\x02{t}\x03" for t in texts]
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.fromiter(map(len, joined), np.int64, len(joined)))
    for n in NGRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for i in range(n):
            h ^= codes[i : i + m]
            h *= np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        inside = row[:m] == row[n - 1 :]
        yield ((h >> np.uint64(17)) & np.uint64((1 << BITS) - 1))[inside].astype(np.int32), row[:m][inside]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, offset of each text's first gram, number of its grams), all n together, for training."""
    parts = list(_hashed(texts))
    h, r = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    h = h[np.argsort(r, kind="stable")]
    counts = np.bincount(r, minlength=len(texts))
    return h, np.concatenate([[0], np.cumsum(counts)[:-1]]), counts


def summed(weights: np.ndarray, texts: list[str]) -> np.ndarray:
    """Sum of the weights of each text's grams, scaled by their number (see scaled)."""
    out = np.zeros((len(texts), weights.shape[1]), dtype=np.float32)
    number = np.zeros(len(texts), dtype=np.int64)
    for h, r in _hashed(texts):
        counts = np.bincount(r, minlength=len(texts))
        number += counts
        have = np.flatnonzero(counts)
        ends = np.cumsum(counts[have])
        for lo, hi in _slices(ends, 1_000_000):
            first = ends[lo - 1] if lo else 0
            starts = np.concatenate([[first], ends[lo : hi - 1]]) - first
            out[have[lo:hi]] += np.add.reduceat(weights[h[first : ends[hi - 1]]], starts, axis=0)
    return out * scaled(number)[:, None]


#: Grams of a text up to which evidence adds up; the grams of a longer text count by their mean.
GRAMS = 600


def scaled(number: np.ndarray) -> np.ndarray:
    """The factor of the sum over so many grams: one over the root, and over the number itself beyond GRAMS."""
    n = np.maximum(number, 1)
    return np.where(n <= GRAMS, 1 / np.sqrt(n), np.sqrt(GRAMS) / n)


def _slices(ends: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``step`` grams each, one text at least."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step, "right")))
        yield lo, hi
        lo = hi


class Pair:
    """The parts of a pair that features need. vocabulary: sorted words of the training sample."""

    __slots__ = ("raw", "answer", "broken", "content", "body", "copied", "quoted", "target", "specific", "value", "ending", "words", "last", "half", "hanging", "closed")

    def __init__(self, question: str, raw: str | None, vocabulary: list[str]) -> None:
        q = _asked(question)
        self.raw = raw or ""
        self.answer, self.broken = unwrapped(self.raw)
        self.content = bare(self.answer)
        text = normal(self.answer)
        self.quoted = self.copied = False
        for whole in q.forms:
            if whole in text:
                text, self.quoted = text.replace(whole, " "), True
        if self.quoted:
            text = _REQUEST.sub(" ", text) if q.wanted else text
            left = re.sub(r"[\W_]+", "", re.sub(r"^\W*(?:q|question|frage|pregunta|вопрос|问题|问)\b|\b(?:a|answer)\W*$", "", _TAGS.sub(" ", text).strip()))
            self.copied = not left or bool(_LEAD.fullmatch(text.strip()))
        self.target = q.wanted
        self.words = text.count(" ") + 1
        outside = _QUOTED.sub(" ", text)  # what an answer quotes, a refusal for example, isn't what it says
        self.body = outside if _LETTERS.search(outside) else text
        self.value = bool(_VALUE.search(outside))
        self.specific = not q.specific.isdisjoint(_TOKEN.findall(outside))
        self.ending = _ending(self.answer, self.broken)
        self.last = normal(_last_word(self.answer))
        self.half = _half(self.last, text, vocabulary)
        self.hanging = self.last in _WORDS
        self.closed = all(self.answer.count(a) <= self.answer.count(b) for a, b in ("()", "[]", "（）", "“”", "«»"))


def _last_word(text: str) -> str:
    """The word at the end of a text that no mark follows."""
    end = at = len(text.rstrip())
    while at and (text[at - 1].isalpha() or text[at - 1] == "'"):
        at -= 1
    return text[at:end].strip("'")


class _Asked:
    __slots__ = ("forms", "wanted", "specific", "core")

    def __init__(self, question: str) -> None:
        named = _WANTED.search(question)
        self.wanted = _NAMES.get(named[1].lower()) if named else None
        self.core = _REQUEST.sub(" ", question).strip() if named else question
        strip = lambda t: normal(t).strip(" .?!¿¡。？！;:\"'")
        forms = {strip(question), strip(self.core), normal(question), normal(self.core)}
        self.forms = sorted((f for f in forms if len(f) >= 4), key=len, reverse=True)
        self.specific = frozenset(normal(s) for s in _SPECIFIC.findall(self.core))


_asked = lru_cache(50_000)(_Asked)


def _half(word: str, text: str, vocabulary: list[str]) -> bool:
    """Whether ``word`` is no word of the vocabulary, stands but once in the text and begins a word of the vocabulary."""
    at = bisect.bisect_left(vocabulary, word)
    if at < len(vocabulary) and vocabulary[at] == word or text.count(word) > 1:
        return False
    return bool(word) and at < len(vocabulary) and vocabulary[at].startswith(word)


def _ending(answer: str, broken: bool) -> str:
    """How an answer ends: mark (it says that it is cut), open (JSON, fence or quotation not closed), whole (a terminal
    mark), list, note (a bracket or symbol after it), comma (a mark that goes on), value (a bare value) or loose."""
    if broken:
        return "open"
    t = answer.rstrip()
    if _CUT_MARK.search(t):
        return "mark"
    if t.count("```") % 2:
        return "open"
    if t.endswith("```"):
        return "whole"
    last = t.rpartition("\n")[2].strip()
    if re.match(r"[-*•]\s+\S", last) and "\n" in t:
        return "list"
    s = t.rstrip(_CLOSERS)
    if s and s[-1] in _ENDS:
        return "whole"
    if not s or t[-1] in ")）" and ("(" in t or "（" in t):
        return "note" if s else "whole"
    c = t[-1]
    if c in ",;:、，；：-–—/&+=":
        return "comma"
    if unicodedata.category(c) in ("So", "Sm", "Sk", "Mn"):
        return "note"
    plain = re.sub(r"\\boxed|[*`=${}\\]|answer:?", "", t).strip()
    if len(plain) <= 40 and re.fullmatch(r"[-+]?[\d.,:/%]+|[A-Za-z\u00c0-\u04ff]{1,24}(?:-[A-Za-z\u00c0-\u04ff]{1,24})*|[\u3040-\u9fff\uac00-\ud7a3]{1,6}", plain) and len(t.split()) <= 3:
        return "value"
    return "loose"


ENDINGS = ["mark", "open", "whole", "list", "comma", "note", "value", "loose"]
DENSE, SCALE = 32, 3.0  # number of features, and what they count beside a gram (their weights grow faster in training)


def dense(pair: Pair, margin: float) -> list[float]:
    """Features of the pair besides n-grams; margin: how far its language is the one asked for (negative: another)."""
    x = [0.0] * DENSE
    x[ENDINGS.index(pair.ending)] = 1.0
    x[8] = not pair.content
    x[9], x[10] = pair.copied, pair.quoted and not pair.copied
    x[11], x[12], x[13] = pair.specific, pair.value, not (pair.specific or pair.value)
    x[14] = min(len(pair.body), 400) / 400
    x[15] = len(pair.body) < 30
    x[16], x[17], x[18] = margin < -0.25, margin > 0.25, abs(margin) <= 0.25
    x[19] = max(-1.0, min(1.0, margin))
    x[20] = x[13] and pair.ending == "whole" and not pair.copied and bool(pair.content)
    x[21] = pair.ending == "loose" and not pair.copied and bool(pair.content)
    x[22] = bool(pair.content) and not pair.copied and pair.words > 3
    x[23] = x[16] and (pair.specific or pair.value)
    said = bool(pair.content) and not pair.copied
    x[24], x[25] = said and pair.half, said and pair.hanging
    x[26] = said and pair.ending in ("loose", "value", "list") and not pair.half and not pair.hanging
    x[27] = said and not pair.closed
    x[28] = said and pair.value and pair.words <= 3
    x[29] = said and pair.words <= 3 and not pair.value
    x[30] = margin < -0.5 and said
    x[31] = said and pair.ending == "loose" and pair.words <= 3
    return [SCALE * v for v in x]


class Classifier:
    """Weights of the hashed n-grams (defects, then languages), of the dense features, biases and thresholds."""

    def __init__(self, wide: np.ndarray, tongue: np.ndarray, deep: np.ndarray, bias: np.ndarray, thresholds: np.ndarray, vocabulary: list[str]) -> None:
        self.wide, self.tongue, self.deep, self.bias, self.thresholds, self.vocabulary = wide, tongue, deep, bias, thresholds, vocabulary
        self.both = np.hstack([wide, tongue]).astype(np.float32)
        self.report: dict[str, tuple[float, float]] = {}  # precision and recall of each class over the held-out pairs
        self._spoken: dict[str, str | None] = {}

    def languages(self, texts: list[str], scores: np.ndarray) -> list[tuple[str | None, np.ndarray]]:
        """(language, probabilities over CODES) of each text; None without enough letters. Scripts other than Latin tell
        their language; the n-grams tell the languages in Latin letters."""
        e = np.exp(3 * (scores - scores.max(1, keepdims=True)))
        p = np.zeros((len(texts), len(CODES)))
        p[:, : len(LATIN)] = e / e.sum(1, keepdims=True)
        found = []
        for text, row in zip(texts, p):
            by = script_language(text)
            if by:
                row[:] = 0.0
                row[CODES.index(by)] = 1.0
            letters = sum(map(len, _LETTERS.findall(text)))
            found.append((CODES[int(row.argmax())] if by is not None and letters >= (4 if by not in ("", "ru") else 10) else None, row))
        return found

    def spoken(self, question: str) -> str | None:
        """The language of a question (without the request for a language)."""
        if question not in self._spoken:
            if len(self._spoken) > 20_000:
                self._spoken.clear()
            core = _plain(normal(_asked(question).core))
            self._spoken[question] = surely(core) or self.languages([core], summed(self.tongue, [core]))[0][0]
        return self._spoken[question]

    def scored(self, questions: list[str], answers: list[str | None]) -> tuple[list[Pair], np.ndarray, np.ndarray, list[str | None]]:
        """(pairs, logits of the defects, margins of the language, languages of the answers)."""
        pairs = [Pair(q, a, self.vocabulary) for q, a in zip(questions, answers)]
        bodies = [_DIGITS.sub("0", p.body) for p in pairs]
        both = summed(self.both, bodies)
        k = len(CLASSES)
        plain = [_plain(b) if len(b) < 60 else b for b in bodies]
        tongues = self.languages(plain, both[:, k:])
        margins = np.zeros(len(pairs))
        for i, (p, (code, row)) in enumerate(zip(pairs, tongues)):
            want = p.target or self.spoken(questions[i])
            if code is not None and want is not None:
                mine = row[CODES.index(want)]
                margins[i] = mine - max(x for c, x in zip(CODES, row) if c != want)
        x = np.array([dense(p, m) for p, m in zip(pairs, margins)])
        return pairs, both[:, :k] + x @ self.deep + self.bias, margins, [t for t, _ in tongues]

    def defects(self, questions: list[str], answers: list[str | None]) -> list[str | None]:
        """The defect of each pair: of the classes over their thresholds the one furthest over. Long texts are taken
        whole, a few at a time, so memory doesn't follow their number."""
        found: list[str | None] = []
        at, chars = 0, 0
        for i in range(len(answers)):
            chars += len(answers[i] or "")
            if chars > 1_000_000 or i + 1 == len(answers):
                _, logits, _, _ = self.scored(questions[at : i + 1], answers[at : i + 1])
                found += [None if c < 0 else CLASSES[c] for c in self.decided(logits)]
                at, chars = i + 1, 0
        return found

    def decided(self, logits: np.ndarray) -> np.ndarray:
        """Index of the class of each row of logits, -1 for none."""
        over = (_sigmoid(logits) - self.thresholds) / (1 - self.thresholds)
        best = over.argmax(1)
        return np.where(over[np.arange(len(over)), best] >= 0, best, -1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _plain(text: str) -> str:
    """Text without identifiers, names in Latin letters being the same in every language."""
    return _SPACES.sub(" ", re.sub(r"(?<![a-z])[a-z]++-[a-z]+|\d+", " ", text))


def broken(rng: np.random.Generator, sound: list[tuple[str, str, str]], refusals: dict[str, list[str]], about: dict[str, list[str]]) -> tuple[list[str], list[str | None], np.ndarray]:
    """Questions, answers and 0/1 labels by class: every sound pair (question, answer, language) as it is, in sound
    variations, and broken in each way. Sound variations include bare values, answers without a final mark, answers that
    repeat the question or quote a refusal, and answers in the language that the question asks for."""
    questions: list[str] = []
    answers: list[str | None] = []
    labels: list[int] = []
    by: dict[str, list[int]] = {}
    for i, (_, _, code) in enumerate(sound):
        by.setdefault(code, []).append(i)
    prose = {code: text.split("|") for code, text in PROSE.items()}
    pick = lambda some: some[int(rng.integers(len(some)))]

    def put(q: str, a: str | None, kind: int) -> None:
        questions.append(q)
        answers.append(json.dumps({"answer": a}, ensure_ascii=False) if a is not None and rng.random() < 0.1 else a)
        labels.append(kind)

    for q, a, code in sound:
        put(q, a, -1)
        tokens = re.findall(r"[^\W\d_]+-[^\W\d_]+|\d+", a)
        bare_ = a.rstrip(".。!！")
        if tokens and _VALUE.search(a):
            t = tokens[0]
            put(q, pick([t, f"= {t}", f"**{t}**", f"{t}.", f"\\boxed{{{t}}}"]), -1)
        put(q, pick([f"{q} {a}", f"{a}\n", f"{bare_} ✅", f"{a}\n- {tokens[0]}" if tokens else a, f"{bare_} ({tokens[0]})" if tokens else a, f"{a}\n\n```\n{tokens[0]}\n```" if tokens else a]), -1)
        held = refusals.get(code) or refusals["en"]
        if rng.random() < 0.15:
            put(q, f'{a} ("{pick(held)}")', -1)
        if rng.random() < 0.01 and bare_ != a:
            put(q, bare_, -1)
        if rng.random() < 0.1:
            name = pick([w for w in _SPECIFIC.findall(q) if len(w) > 2] or [""])
            put(q, name, -1) if name else None
        if tokens and rng.random() < 0.15:
            put(q, f"{a}\n\n```\nvalue = {tokens[-1]}\n", 1)
        cut = a[: max(2, int(len(a) * rng.uniform(0.05, 0.97)))]
        if cut.rstrip(_CLOSERS)[-1:] not in _ENDS and not re.fullmatch(r"\W*\d*\W*", cut):
            tail = pick(["", "", "", "", ",", "...", "…", "\n", " [truncated]", "...", "…", " [max tokens reached]"])
            put(q, cut + tail, 1) if rng.random() < 0.8 else (questions.append(q), answers.append('{"answer": "' + cut), labels.append(1))
        put(q, pick([q, q.lower(), q.upper(), f"Q: {q}", f'"{q}"', f"{q}\n\n{q}", q.rstrip("?.。？"), f"  {q.replace(' ', '  ')} ", f"{pick(LEADS)} {q}"]), 3)
        other = [c for c in by if c != code]
        if other:
            put(q, sound[pick(by[pick(other)])][1], 4)
        put(q, sound[pick(by[code])][1], -1)  # it may answer something else, but none of the defects is there
        foreign = pick([c for c in prose if c != code])
        put(q, pick(prose[foreign]), 4)
        if code in prose:
            put(q, pick([t for t in prose[code] if t != q]), -1)
        if rng.random() < 0.2 and other:  # an answer in another language, asked for
            wanted = pick([c for c in other if c in LANGUAGE_NAMES] or ["en"])
            asked = f"{q} Answer in {LANGUAGE_NAMES[wanted][0].capitalize()}."
            if wanted in by:
                put(asked, sound[pick(by[wanted])][1], -1)
                put(asked, a, 4)
        held = held if rng.random() < 0.8 else refusals["en"]
        said = [held[int(j)] for j in rng.permutation(len(held))[: 1 + (rng.random() < 0.3)]]
        put(q, " ".join(said), 2)
        named = [w for w in _SPECIFIC.findall(q)]
        subject = pick([" ".join(named[:2]) or q, q.rstrip("?？.。").lower(), q.rstrip("?？.。")])
        put(q, pick(about.get(code) or about["en"]).format(subject), 2)
        put(q, pick(PLACEHOLDERS), 0)
    y = np.zeros((len(labels), len(CLASSES)), dtype=np.float32)
    for i, kind in enumerate(labels):
        if kind >= 0:
            y[i, kind] = 1
    return questions, answers, y


def _fit_linear(h: np.ndarray, starts: np.ndarray, counts: np.ndarray, extra: np.ndarray, y: np.ndarray, softmax: bool, rng: np.random.Generator, epochs: int = 4, rate: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by mini-batches with Adam: (weights of the grams, of the dense features, biases)."""
    k, d, e = y.shape[1], 1 << BITS, extra.shape[1]
    params = [np.zeros((d, k)), np.zeros((e, k)), np.zeros(k)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 1024):
            rows = order[at : at + 1024]
            idx = np.concatenate([h[starts[i] : starts[i] + counts[i]] for i in rows])
            owner = np.repeat(np.arange(len(rows)), counts[rows])
            scale = scaled(counts[rows])
            z = np.stack([np.bincount(owner, params[0][idx, c], len(rows)) for c in range(k)], 1) * scale[:, None] + extra[rows] @ params[1] + params[2]
            if softmax:
                z = np.exp(z - z.max(1, keepdims=True))
                p = z / z.sum(1, keepdims=True)
            else:
                p = 1 / (1 + np.exp(-z))
            g = (p - y[rows]) / len(rows)
            per = (g * scale[:, None])[owner]
            grads = [np.stack([np.bincount(idx, per[:, c], d) for c in range(k)], 1), extra[rows].T @ g, g.sum(0)]
            step += 1
            for p_, g_, a, b in zip(params, grads, m1, m2):
                a *= 0.9
                a += 0.1 * g_
                b *= 0.99
                b += 0.01 * g_ * g_
                p_ -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return params[0], params[1], params[2]


#: Share of sound pairs that thresholds are calibrated for, and the number of held-out parts: one of them calibrates.
SOUND_SHARE, FOLDS = 0.9, 5


def _split(held: dict[str, list[str]], last: bool) -> dict[str, list[str]]:
    """The last quarter of each language's texts, or the rest; few texts are in both."""
    cut = {code: max(1, len(texts) - max(1, len(texts) // 4)) for code, texts in held.items()}
    return {code: (texts[cut[code] :] or texts if last else texts[: cut[code]]) for code, texts in held.items()}


def calibrated(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The threshold of each class: the middle of those whose F1 is within two hundredths of the best, where SOUND_SHARE of all
    pairs are sound."""
    sound = y.sum(1) == 0
    weight = np.where(sound, SOUND_SHARE / max(1, sound.sum()), (1 - SOUND_SHARE) / max(1, (~sound).sum()))
    grid, found = np.linspace(0.02, 0.98, 97), []
    for c in range(y.shape[1]):
        truth = y[:, c] > 0.5
        f1 = np.array([2 * weight[truth & (p[:, c] >= t)].sum() / max(1e-12, weight[truth].sum() + weight[p[:, c] >= t].sum()) for t in grid])
        found.append(grid[np.flatnonzero(f1 >= f1.max() - 0.02)].mean())
    return np.array(found)


def fitted(sample: list[tuple[str, str | None]], seed: int = 0) -> Classifier:
    """A classifier from pairs (question, answer), most of which are sound. Pairs whose answer surely is sound (it ends, in
    the language asked for, it is no copy and names something that the question names) are the training stock. A part of
    them is held out with refusals that training doesn't see; their broken versions calibrate the thresholds."""
    rng = np.random.default_rng(seed)
    texts, codes = [], []
    for q, a in sample:
        sure = [surely(_plain(normal(t))) for t in (_asked(q).core, a or "")]
        if sure[0] is None and _asked(q).wanted is None:
            sure[0] = sure[1]  # most answers are in the language of the question
        for t, code in zip((_asked(q).core, a or ""), sure):
            plain = _plain(_DIGITS.sub("0", normal(t)))
            if code in LATIN and len(plain) > 12:
                texts.append(plain)
                codes.append(code)
    for source in (REFUSALS, {c: t.split("|") for c, t in PROSE.items()}, {c: [" ".join(ws)] for c, ws in FUNCTION_WORDS.items()}):
        for code, held in source.items():
            if code in LATIN:
                texts += [_plain(normal(t)) for t in held] * 20
                codes += [code] * len(held) * 20
    counts: dict[str, int] = {}
    for q, a in sample:
        for word in {*normal(q).split(), *normal(a or "").split()}:
            word = word.strip(".,;:!?()[]\"'*`")
            counts[word] = counts.get(word, 0) + 1
    vocabulary = sorted(w for w, c in counts.items() if c > 1 and w)
    h, s, n = grams(texts)
    one_hot = np.array([[float(c == k) for k in LATIN] for c in codes], dtype=np.float32)
    tongue, _, _ = _fit_linear(h, s, n, np.zeros((len(texts), 1)), one_hot, True, rng, epochs=6, rate=0.05)
    none = np.zeros((1 << BITS, len(CLASSES)))
    blank = Classifier(none, tongue, np.zeros((DENSE, len(CLASSES))), np.zeros(len(CLASSES)), np.full(len(CLASSES), 0.5), vocabulary)
    sound = []
    for q, a in sample:
        if q and a:
            pair = Pair(q, a, vocabulary)
            want, code = pair.target or blank.spoken(q), surely(pair.body)
            if pair.ending == "whole" and not pair.quoted and pair.specific and code and code == want and pair.words > 3 or (code == want and code in ("zh", "ja", "th") and pair.ending == "whole" and pair.specific and not pair.quoted):
                sound.append((q, pair.answer, code))
    for code, text in PROSE.items():  # every language has some sound pairs
        said = text.split("|")
        sound += [(said[i], said[i + 1], code) for i in (0, 2)]
    parts = np.arange(len(sound)) % FOLDS == FOLDS - 1
    made = []
    for last in (False, True):
        stock = [x for x, held_out in zip(sound, parts) if held_out == last] or sound
        questions, answers, y = broken(rng, stock, _split(REFUSALS, last), _split(REFUSALS_ABOUT, last))
        pairs, _, margins, _ = blank.scored(questions, answers)
        made.append(([_DIGITS.sub("0", p.body) for p in pairs], np.array([dense(p, m) for p, m in zip(pairs, margins)]), y))
    bodies, x, y = made[0]
    wide, deep, bias = _fit_linear(*grams(bodies), x, y, False, rng, epochs=max(4, min(60, 40_000 // max(1, len(y)) * 4)))
    bodies, x, y = made[1]
    logits = summed(wide.astype(np.float32), bodies) + x @ deep + bias
    model = Classifier(wide, tongue, deep, bias, calibrated(_sigmoid(logits), y), vocabulary)
    told = model.decided(logits)
    for c, kind in enumerate(CLASSES):
        hits = int(((told == c) & (y[:, c] > 0)).sum())
        model.report[kind] = (hits / max(1, int((told == c).sum())), hits / max(1, int(y[:, c].sum())))
    return model


def pairs(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """Every answer with its question: source_table, record_id, input (raw JSON of the question, null if the case is
    unknown), answer (raw). Answers of cases are their expected_output (a null column is no case). Copies of rows fall
    together; of several inputs of one case the one with the least record_id is the question."""
    own = cases.filter("expected_output is not null").select(F.lit("cases").alias("source_table"), "record_id", "input", F.col("expected_output").alias("answer")).distinct()
    key = case_key_or_derived(F.col("case_key"), F.col("dataset_id"), F.col("case_id"))
    # written first, so that both sides of the join are plain exchanges, of which the hot ones can be split
    asked = staged(cases.groupBy(key.alias("__key")).agg(F.min(F.struct("record_id", "input")).alias("__q")).select("__key", F.col("__q.input").alias("input")))
    said = responses.select(F.lit("judge_responses").alias("source_table"), F.col("response_id").alias("record_id"), key.alias("__key"), F.col("raw_response").alias("answer"))
    return own.unionByName(said.join(asked, "__key", "left").select("source_table", "record_id", "input", "answer"))


def trained(cases: DataFrame, sample: int = SAMPLE) -> Classifier:
    """The classifier for these data, fitted on a bounded sample of the cases (SAMPLE rows, a few hundred KB): those with
    the least hashes. Rows far above the expected bound of the hash are left out before they are sorted."""
    rows = cases.filter("expected_output is not null").select("record_id", "input", "expected_output").distinct()
    hashed = rows.withColumn("__h", F.xxhash64("record_id", "input", "expected_output"))
    share = min(1.0, (2 * sample + 100) / max(1, cases.filter("expected_output is not null").count()))
    near = hashed.filter(F.col("__h") <= int(-(2**63) + share * (2**64 - 1))) if share < 0.5 else hashed
    held = staged(near.orderBy("__h", "record_id", "input", "expected_output").limit(sample)).collect()
    return fitted([(question_text(r["input"]), unwrapped(r["expected_output"])[0]) for r in held])


def defective(cases: DataFrame, responses: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """source_table, record_id, defect_type: one row for each defective answer.

    A null answer of a response is empty. Null or unreadable questions are empty questions: copies and wrong languages
    can't be told then, other defects can. Texts of any length are read whole. Repeated rows count once.
    """
    model = trained(cases, sample)
    state = (model.wide.astype(np.float32), model.tongue.astype(np.float32), model.deep, model.bias, model.thresholds, model.vocabulary)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Classifier(*state)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                table, raw, answer = part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()
                asked = [(question_text(q), unwrapped(a)[0] if t == "cases" and a and a.lstrip()[:1] == '"' else a) for t, q, a in zip(table, raw, answer)]
                once = list(dict.fromkeys(asked))  # models often give the same answer to a case
                told = dict(zip(once, mine.defects([q for q, _ in once], [a for _, a in once])))
                found = [told[x] for x in asked]
                keep = pa.array([i for i, d in enumerate(found) if d], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array([d for d in found if d], pa.string())], names=["source_table", "record_id", "defect_type"])

    return pairs(cases, responses).mapInArrow(judge, "source_table string, record_id bigint, defect_type string").distinct()
