"""Which language a short text is in: a script, or for Latin letters a character model per language.

The models are fitted here, on the sample texts below (the Universal Declaration of Human Rights, articles 1 to 5, 9, 15 and
25, as published by the United Nations, and common words) and on the stop words that Spark ML carries.
Nothing in them comes from the texts that are judged.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import SparkSession

#: Sample texts by language.
SAMPLES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone has the right to life, liberty and security of person. No one shall be held in slavery or servitude; slavery and the slave trade shall be prohibited in all their forms. No one shall be subjected to torture or to cruel, inhuman or degrading treatment or punishment. No one shall be subjected to arbitrary arrest, detention or exile. Everyone has the right to a nationality. Yes, no, not any, none, many, much, more, less, most, least, than, until, each, every, before, after, above, below, up to, first, second, which, what, how, price, cost, costs, charge, charged, rate, fee, amount, amounts, total, sum, unit, units, day, days, hour, night, visit, item, test, procedure, per cent, cents, discount, increase, premium, limit, cap, clause, table, schedule, summary, contract, agreement, service, billed, paid, applies, applied, agreed, stated, listed, multiplied, rounded, rounding, quantity, whole, further, dearer, cheaper, therefore, because, since, only, nothing, answer, source, quote.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Niemand darf in Sklaverei oder Leibeigenschaft gehalten werden; Sklaverei und Sklavenhandel in allen ihren Formen sind verboten. Niemand darf der Folter oder grausamer, unmenschlicher oder erniedrigender Behandlung oder Strafe unterworfen werden. Niemand darf willkürlich festgenommen, in Haft gehalten oder des Landes verwiesen werden. Jeder hat das Recht auf eine Staatsangehörigkeit. Jeder hat Anspruch auf die in dieser Erklärung verkündeten Rechte und Freiheiten ohne irgendeinen Unterschied, etwa nach Rasse, Hautfarbe, Geschlecht, Sprache, Religion, politischer oder sonstiger Überzeugung, nationaler oder sozialer Herkunft, Vermögen, Geburt oder sonstigem Stand. Jeder hat das Recht auf einen Lebensstandard, der seine und seiner Familie Gesundheit und Wohl gewährleistet, einschließlich Nahrung, Kleidung, Wohnung, ärztliche Versorgung und notwendige soziale Leistungen, sowie das Recht auf Sicherheit im Falle von Arbeitslosigkeit, Krankheit, Invalidität oder Verwitwung, im Alter sowie bei anderweitigem Verlust seiner Unterhaltsmittel durch unverschuldete Umstände. Ja, nein, es gibt, was, wie viel, wann, warum, heute, morgen, jedoch, mehr, weniger, Preis, Tag, Jahr, Zahl.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Nul ne sera tenu en esclavage ni en servitude; l'esclavage et la traite des esclaves sont interdits sous toutes leurs formes. Nul ne sera soumis à la torture, ni à des peines ou traitements cruels, inhumains ou dégradants. Nul ne peut être arbitrairement arrêté, détenu ou exilé. Tout individu a droit à une nationalité. Chacun peut se prévaloir de tous les droits et de toutes les libertés proclamés dans la présente Déclaration, sans distinction aucune, notamment de race, de couleur, de sexe, de langue, de religion, d'opinion politique ou de toute autre opinion, d'origine nationale ou sociale, de fortune, de naissance ou de toute autre situation. Toute personne a droit à un niveau de vie suffisant pour assurer sa santé, son bien-être et ceux de sa famille, notamment pour l'alimentation, l'habillement, le logement, les soins médicaux ainsi que pour les services sociaux nécessaires. Oui, non, il y a, combien, quand, pourquoi, aujourd'hui, demain, cependant, plus, moins, prix, jour, année, nombre.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Nadie estará sometido a esclavitud ni a servidumbre; la esclavitud y la trata de esclavos están prohibidas en todas sus formas. Nadie será sometido a torturas ni a penas o tratos crueles, inhumanos o degradantes. Nadie podrá ser arbitrariamente detenido, preso ni desterrado. Toda persona tiene derecho a una nacionalidad. Toda persona tiene los derechos y libertades proclamados en esta Declaración, sin distinción alguna de raza, color, sexo, idioma, religión, opinión política o de cualquier otra índole, origen nacional o social, posición económica, nacimiento o cualquier otra condición. Toda persona tiene derecho a un nivel de vida adecuado que le asegure, así como a su familia, la salud y el bienestar, y en especial la alimentación, el vestido, la vivienda, la asistencia médica y los servicios sociales necesarios. Sí, no, hay, cuánto, cuándo, por qué, hoy, mañana, sin embargo, más, menos, precio, día, año, número.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Ogni individuo ha diritto alla vita, alla libertà ed alla sicurezza della propria persona. Nessun individuo potrà essere tenuto in stato di schiavitù o di servitù; la schiavitù e la tratta degli schiavi saranno proibite sotto qualsiasi forma. Nessun individuo potrà essere sottoposto a tortura o a trattamento o a punizione crudeli, inumani o degradanti. Nessun individuo potrà essere arbitrariamente arrestato, detenuto o esiliato. Ogni individuo ha diritto ad una cittadinanza. Ad ogni individuo spettano tutti i diritti e tutte le libertà enunciate nella presente Dichiarazione, senza distinzione alcuna, per ragioni di razza, di colore, di sesso, di lingua, di religione, di opinione politica o di altro genere, di origine nazionale o sociale, di ricchezza, di nascita o di altra condizione. Ogni individuo ha diritto ad un tenore di vita sufficiente a garantire la salute e il benessere proprio e della sua famiglia, con particolare riguardo all'alimentazione, al vestiario, all'abitazione, e alle cure mediche e ai servizi sociali necessari. Sì, no, non, c'è, quanto, quando, perché, oggi, domani, tuttavia, più, meno, prezzo, giorno, anno, numero.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Todo o indivíduo tem direito à vida, à liberdade e à segurança pessoal. Ninguém será mantido em escravatura ou em servidão; a escravatura e o trato dos escravos, sob todas as formas, são proibidos. Ninguém será submetido a tortura nem a penas ou tratamentos cruéis, desumanos ou degradantes. Ninguém pode ser arbitrariamente preso, detido ou exilado. Todo o indivíduo tem direito a ter uma nacionalidade. Todos os seres humanos podem invocar os direitos e as liberdades proclamados na presente Declaração, sem distinção alguma, nomeadamente de raça, de cor, de sexo, de língua, de religião, de opinião política ou outra, de origem nacional ou social, de fortuna, de nascimento ou de qualquer outra situação. Toda a pessoa tem direito a um nível de vida suficiente para lhe assegurar e à sua família a saúde e o bem-estar, principalmente quanto à alimentação, ao vestuário, ao alojamento, à assistência médica e ainda quanto aos serviços sociais necessários. Sim, não, há, quanto, quando, porque, hoje, amanhã, no entanto, mais, menos, preço, dia, ano, número.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Een ieder heeft recht op leven, vrijheid en onschendbaarheid van zijn persoon. Niemand zal in slavernij of horigheid gehouden worden. Slavernij en slavenhandel in iedere vorm zijn verboden. Niemand zal onderworpen worden aan folteringen, noch aan een wrede, onmenselijke of onterende behandeling of bestraffing. Niemand zal onderworpen worden aan willekeurige arrestatie, detentie of verbanning. Een ieder heeft het recht op een nationaliteit. Een ieder heeft aanspraak op alle rechten en vrijheden, in deze Verklaring opgesomd, zonder enig onderscheid van welke aard ook, zoals ras, kleur, geslacht, taal, godsdienst, politieke of andere overtuiging, nationale of maatschappelijke afkomst, eigendom, geboorte of andere status. Een ieder heeft recht op een levensstandaard, die hoog genoeg is voor de gezondheid en het welzijn van zichzelf en zijn gezin, waaronder inbegrepen voeding, kleding, huisvesting en geneeskundige verzorging en de noodzakelijke sociale diensten. Ja, nee, er is, hoeveel, wanneer, waarom, vandaag, morgen, echter, meer, minder, prijs, dag, jaar, getal.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap. Var och en har rätt till liv, frihet och personlig säkerhet. Ingen får hållas i slaveri eller träldom. Slaveri och slavhandel i alla former är förbjudna. Ingen får utsättas för tortyr eller grym, omänsklig eller förnedrande behandling eller bestraffning. Ingen får godtyckligt anhållas, fängslas eller landsförvisas. Var och en har rätt till en nationalitet. Ja, nej, det finns, inget, hur mycket, när, varför, idag, imorgon, dock, mer, mindre, pris, dag, år, antal.",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. Enhver har ret til liv, frihed og personlig sikkerhed. Ingen må holdes i slaveri eller trældom; slaveri og slavehandel under alle former er forbudt. Ingen må underkastes tortur eller grusom, umenneskelig eller nedværdigende behandling eller straf. Ingen må underkastes vilkårlig anholdelse, tilbageholdelse eller landsforvisning. Enhver har ret til en nationalitet. Ja, nej, der er, intet, hvor meget, hvornår, hvorfor, i dag, i morgen, dog, mere, mindre, pris, dag, år, antal.",
    "no": "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd. Enhver har rett til liv, frihet og personlig sikkerhet. Ingen må holdes i slaveri eller trelldom. Slaveri og slavehandel i alle former er forbudt. Ingen må utsettes for tortur eller grusom, umenneskelig eller nedverdigende behandling eller straff. Ingen må utsettes for vilkårlig arrest, fengsling eller landsforvisning. Enhver har rett til et statsborgerskap. Ja, nei, det er, ingen, hvor mye, når, hvorfor, i dag, i morgen, likevel, mer, mindre, pris, dag, år, antall.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Kullakin yksilöllä on oikeus elämään, vapauteen ja henkilökohtaiseen turvallisuuteen. Ketään ei saa pitää orjana tai orjuutettuna; kaikki orjuuden ja orjakaupan muodot on kiellettävä. Ketään ei saa kiduttaa eikä kohdella tai rangaista julmasti, epäinhimillisesti tai alentavasti. Ketään ei saa mielivaltaisesti pidättää, vangita tai ajaa maanpakoon. Jokaisella on oikeus kansalaisuuteen. Kyllä, ei, ei ole, kuinka paljon, milloin, miksi, tänään, huomenna, kuitenkin, enemmän, vähemmän, hinta, päivä, vuosi, määrä.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek ma prawo do życia, wolności i bezpieczeństwa swej osoby. Nie wolno nikogo czynić niewolnikiem ani nakładać na nikogo służebności; niewolnictwo i handel niewolnikami są zakazane we wszystkich swych postaciach. Nie wolno nikogo torturować ani karać lub traktować w sposób okrutny, nieludzki lub poniżający. Nikogo nie wolno samowolnie aresztować, zatrzymywać lub wygnać z kraju. Każdy człowiek ma prawo do posiadania obywatelstwa. Tak, nie, jest, nie ma, za, na, po, od, dla, ile, kiedy, dlaczego, dzisiaj, jutro, jednak, więcej, mniej, cena, dzień, dziennie, rok, liczba.",
    "cs": "Všichni lidé se rodí svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Každý má právo na život, svobodu a osobní bezpečnost. Nikdo nesmí být držen v otroctví nebo nevolnictví; všechny formy otroctví a obchodu s otroky jsou zakázány. Nikdo nesmí být mučen nebo podrobován krutému, nelidskému nebo ponižujícímu zacházení nebo trestu. Nikdo nesmí být svévolně zatčen, držen ve vazbě nebo vyhoštěn do vyhnanství. Každý má právo na státní příslušnost. Ano, ne, je, není, za, na, po, od, pro, kolik, kdy, proč, dnes, zítra, však, více, méně, cena, den, denně, rok, počet.",
    "sk": "Všetci ľudia sa rodia slobodní a sebe rovní, čo sa týka ich dôstojnosti a práv. Sú obdarení rozumom a majú navzájom jednať v bratskom duchu. Každý má právo na život, na slobodu a na osobnú bezpečnosť. Nikoho nemožno držať v otroctve alebo v nevoľníctve; všetky formy otroctva a obchodu s otrokmi sú zakázané. Nikoho nemožno mučiť alebo podrobovať krutému, neľudskému alebo ponižujúcemu zaobchádzaniu alebo trestu. Nikto nesmie byť svojvoľne zatknutý, zadržaný alebo vyhostený do vyhnanstva. Každý má právo na štátnu príslušnosť. Áno, nie, je, nie je, za, na, po, od, pre, koľko, kedy, prečo, dnes, zajtra, však, viac, menej, cena, deň, denne, rok, počet.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Minden személynek joga van az élethez, a szabadsághoz és a személyi biztonsághoz. Senkit sem lehet rabszolgaságban, vagy szolgaságban tartani, a rabszolgaság és a rabszolga-kereskedés minden alakja tilos. Senkit sem lehet kínvallatásnak, avagy kegyetlen, embertelen vagy lealacsonyító büntetésnek vagy bánásmódnak alávetni. Senkit sem lehet önkényesen letartóztatni, fogva tartani, vagy száműzni. Minden személynek joga van valamely állampolgársághoz. Igen, nem, van, nincs, mennyi, mikor, miért, ma, holnap, azonban, több, kevesebb, ár, nap, naponta, év, szám.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. Orice ființă umană are dreptul la viață, la libertate și la securitatea persoanei sale. Nimeni nu va fi ținut în sclavie, nici în servitute; sclavajul și comerțul cu sclavi sunt interzise sub toate formele lor. Nimeni nu va fi supus la torturi, nici la pedepse sau tratamente crude, inumane sau degradante. Nimeni nu trebuie să fie arestat, deținut sau exilat în mod arbitrar. Orice persoană are dreptul la o cetățenie. Da, nu, este, nu este, pe, de, pentru, după, fiecare, cât, când, de ce, azi, mâine, totuși, mai mult, mai puțin, preț, zi, an, număr.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Yaşamak, hürriyet ve kişi emniyeti her ferdin hakkıdır. Hiç kimse kölelik veya kulluk altında bulundurulamaz; kölelik ve köle ticareti her türlü şekliyle yasaktır. Hiç kimse işkenceye, zalimane, gayriinsani, haysiyet kırıcı cezalara veya muamelelere tabi tutulamaz. Hiç kimse keyfi olarak tutuklanamaz, alıkonulanamaz veya sürülemez. Her ferdin bir vatandaşlığa hakkı vardır. Evet, hayır, var, yok, ne kadar, ne zaman, neden, bugün, yarın, ancak, daha fazla, daha az, fiyat, gün, günlük, yıl, sayı.",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan. Setiap orang berhak atas kehidupan, kebebasan dan keselamatan sebagai individu. Tidak seorang pun boleh diperbudak atau diperhambakan; perbudakan dan perdagangan budak dalam bentuk apa pun mesti dilarang. Tidak seorang pun boleh disiksa atau diperlakukan atau dihukum secara kejam, tidak manusiawi atau dihina. Tak seorang pun boleh ditangkap, ditahan atau dibuang dengan sewenang-wenang. Setiap orang berhak atas sesuatu kewarganegaraan. Ya, tidak, ada, bukan, untuk, dari, dengan, adalah, per, setelah, ini, itu, berapa, kapan, mengapa, hari ini, besok, namun, lebih, kurang, harga, hari, tahun, jumlah.",
    "hr": "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i trebaju jedna prema drugima postupati u duhu bratstva. Svatko ima pravo na život, slobodu i osobnu sigurnost. Nitko se ne smije držati u ropstvu ili služnosti; ropstvo i trgovina robljem zabranjuju se u svim svojim oblicima. Nitko se ne smije podvrgnuti mučenju ili okrutnom, nečovječnom ili ponižavajućem postupanju ili kazni. Nitko se ne smije proizvoljno uhititi, pritvoriti ili protjerati. Svatko ima pravo na državljanstvo. Da, ne, je, nije, nema, za, na, po, od, nakon, koliko, kada, zašto, danas, sutra, međutim, više, manje, cijena, dan, dnevno, godina, broj.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình anh em. Mọi người đều có quyền sống, quyền tự do và an toàn cá nhân. Không ai bị bắt làm nô lệ hay bị cưỡng bức lao động như nô lệ; mọi hình thức nô lệ và buôn bán nô lệ đều bị cấm. Không ai phải chịu cực hình, tra tấn, hay bất kỳ hình thức đối xử, hoặc trừng phạt bất nhân, vô nhân đạo. Không ai bị bắt, giam giữ hay lưu đày một cách vô cớ. Ai cũng có quyền có quốc tịch. Có, không, là, của, cho, với, mỗi, sau, bao nhiêu, khi nào, tại sao, hôm nay, ngày mai, hơn, ít, giá, ngày, năm, số.",
    "et": "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Neile on antud mõistus ja südametunnistus ja nende suhtumist üksteisesse peab kandma vendluse vaim. Igaühel on õigus elule, vabadusele ja isikupuutumatusele. Kedagi ei tohi hoida orjuses või sunduses; orjus ja orjakaubandus on keelatud kõigis oma vormides. Kelleltki ei tohi piinata või kohelda julmalt, ebainimlikult või alandavalt. Kedagi ei tohi meelevaldselt vahistada, kinni pidada või maalt välja saata. Igaühel on õigus kodakondsusele. Jah, ei, on, ei ole, kui palju, millal, miks, täna, homme, kuid, rohkem, vähem, hind, päev, päevas, aasta, arv.",
    "ca": "Tots els éssers humans neixen lliures i iguals en dignitat i en drets. Són dotats de raó i de consciència, i els cal mantenir-se entre ells amb esperit de fraternitat. Tota persona té dret a la vida, a la llibertat i a la seva seguretat. Ningú no serà sotmès a esclavitud o servitud: l'esclavitud i el tràfic d'esclaus són prohibits en totes llurs formes. Cap persona no serà sotmesa a tortures ni a penes o tractes cruels, inhumans o degradants. Ningú no pot ésser arrestat, detingut ni exiliat arbitràriament. Tota persona té dret a una nacionalitat. Sí, no, hi ha, quant, quan, per què, avui, demà, però, més, menys, preu, dia, any, nombre.",
}
#: The names under which Spark ML has stop words of these languages.
SPARK_NAMES = {"da": "danish", "nl": "dutch", "en": "english", "fi": "finnish", "fr": "french", "de": "german", "hu": "hungarian", "it": "italian", "no": "norwegian", "pt": "portuguese", "es": "spanish", "sv": "swedish", "tr": "turkish"}
#: Ends of code ranges and the script in them ("" for none or Latin letters).
SCRIPTS = ((0x370, ""), (0x400, "el"), (0x530, "cyrillic"), (0x590, "hy"), (0x600, "he"), (0x700, "ar"), (0x900, ""), (0x980, "hi"), (0x0A00, "bn"), (0xE00, ""), (0xE80, "th"), (0x10A0, ""), (0x1100, "ka"), (0x3040, ""), (0x3100, "ja"), (0x4E00, ""), (0xA000, "zh"), (0xAC00, ""), (0xD7B0, "ko"))
#: The longest context of a letter in letters, the weight of a shorter context beside each different follower of a longer
#: one, and the weight of a language's list of words beside its letters.
CONTEXT, SHORTER, WORD_WEIGHT = 4, 3, 0.5
#: One word speaks for or against a language by at most so much (natural logarithm).
MOST_PER_WORD = 5.0

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def stop_words(spark: SparkSession) -> dict[str, list[str]]:
    """The stop words of Spark ML by language."""
    load = spark._jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords
    return {k: list(load(name)) for k, name in SPARK_NAMES.items()}


class LanguageModel:
    """Letters by the letters before them (interpolated by how many followers each context has) and words, per language."""

    def __init__(self, stops: dict[str, list[str]]):
        self.names = tuple(sorted(SAMPLES))
        self.counts: list[dict[str, dict[str, int]]] = []
        self.words: list[dict[str, float]] = []
        for k in self.names:
            running = [w.lower() for w in _WORD.findall(SAMPLES[k])]
            listed = [w.lower() for w in stops.get(k, ()) if _WORD.fullmatch(w)]
            seen: dict[str, int] = {}
            for w in running + listed:
                seen[w] = seen.get(w, 0) + 1
            n = sum(seen.values())
            self.words.append({w: c / n for w, c in seen.items()})
            c: dict[str, dict[str, int]] = {}
            for w in running + listed:
                s = "^" * CONTEXT + w + "$"
                for i in range(CONTEXT, len(s)):
                    for j in range(CONTEXT + 1):
                        d = c.setdefault(s[i - j : i], {})
                        d[s[i]] = d.get(s[i], 0) + 1
            self.counts.append({x: (d, sum(d.values())) for x, d in c.items()})
        self.of_word = lru_cache(300_000)(self._of_word)
        self.prompt_scores = lru_cache(50_000)(self._prompt_scores)

    def _letters(self, k: int, w: str) -> float:
        counts, s, total = self.counts[k], "^" * CONTEXT + w + "$", 0.0
        for i in range(CONTEXT, len(s)):
            p = 1 / 500  # any letter at all
            for j in range(CONTEXT + 1):
                own = counts.get(s[i - j : i])
                if own is None:
                    break
                d, n = own
                p = (d.get(s[i], 0) + SHORTER * len(d) * p) / (n + SHORTER * len(d))
            total += math.log(p)
        return total

    def _of_word(self, w: str) -> np.ndarray:
        """The logarithm of how probable the word is in each language, no further than MOST_PER_WORD below the best."""
        out = []
        for k in range(len(self.names)):
            letters = math.exp(max(-200.0, self._letters(k, w)))
            out.append(math.log(WORD_WEIGHT * self.words[k].get(w, 0.0) + (1 - WORD_WEIGHT) * letters))
        return np.maximum(out, max(out) - MOST_PER_WORD)

    def scores(self, words: list[str] | tuple[str, ...]) -> np.ndarray:
        """Per language how probable the words are (logarithms)."""
        return np.array([self.of_word(w) for w in words]).sum(axis=0) if words else np.zeros(len(self.names))

    def _prompt_scores(self, words: tuple[str, ...]) -> np.ndarray:
        said = self.scores(words)
        return said - said.max()


@lru_cache(4)
def _model(stops: tuple[tuple[str, tuple[str, ...]], ...]) -> LanguageModel:
    return LanguageModel({k: list(w) for k, w in stops})


def model_of(stops: dict[str, list[str]]) -> LanguageModel:
    """The model, fitted once in a process."""
    return _model(tuple(sorted((k, tuple(w)) for k, w in stops.items())))


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def script_of(text: str) -> str:
    """The script other than Latin that a text is mostly in, '' if there is none."""
    if text.isascii():
        return ""
    scripts: dict[str, int] = {}
    letters = 0
    for c in text:
        if c.isalpha():
            letters += 1
            if c > "ͯ":
                k = next((k for end, k in SCRIPTS if ord(c) < end), "")
                if k:
                    scripts[k] = scripts.get(k, 0) + 1
    if "ja" in scripts:
        scripts["ja"] += scripts.pop("zh", 0)
    if not scripts:
        return ""
    best = max(scripts, key=lambda k: (scripts[k], k))
    return best if scripts[best] >= max(2, 0.3 * letters) else ""
