import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.languages import SAMPLES, model_of, stop_words
from ledgerloom.llm.pairs import common_length, declines, defective_pairs, is_refusal, other_language, shingles, tokens_of

Q = "What does one unit of Rapid Spinal Gait Study cost, and in which basis?"
CASES = [
    (Q, None, "empty"), (Q, "", "empty"), (Q, " ​\n", "empty"), (Q, "ANSWER: n/a", "empty"), (Q, "ANSWER:\n\nSOURCE: table\n\nQUOTE: n/a", "empty"), (Q, '""', "empty"), (Q, "...", "empty"),
    (Q, Q, "copies_question"), (Q, Q[:-1] + ".", "copies_question"), (Q, f"ANSWER: {Q} SOURCE: table", "copies_question"), (Q, f"{Q} {Q}", "copies_question"), (Q, f'You asked: "{Q}"', "copies_question"), (Q, Q.upper(), "copies_question"),
    (Q, f"{Q} GBP 12.50 per hour.", None), (Q, f'You asked: "{Q}" ANSWER: GBP 12.50 per hour. SOURCE: table', None), ("Is A Rapid Study cheaper than an Urgent Scan?", "A Rapid Study", None),
    (Q, "I'm sorry, but I can't help with that.", "refusal"), (Q, "ANSWER: Not permitted to disclose. SOURCE: none QUOTE: none", "refusal"), (Q, "No comment on Rapid Spinal Gait Study; kindly consult a qualified auditor.", "refusal"), (Q, "I am unable to provide you with an answer.", "refusal"),
    (Q, "I cannot find a cap for it in the summary, so the answer is no: any quantity may be billed.", None), (Q, "Sorry to be brief: no limit applies.", None),
    (Q, "Der vereinbarte Satz beträgt 12 Cent je Einheit und gilt für die gesamte Laufzeit.", "other_language"), (Q, "契約の単価は514セントです。", "other_language"), ("Was kostet eine Einheit Rapid Spinal Gait Study am 2024-06-09?", "The charge is 12 cents for each unit of the day.", "other_language"),
    ("Was kostet eine Einheit Rapid Spinal Gait Study am 2024-06-09?", "Je Einheit werden GBP 12.50 berechnet.", None), ("¿Hay un límite diario para Rapid Spinal Gait Study?", "No.", None), (Q, "GBP 12.50", None), (Q, "46", None), (Q, "No.", None),
    (Q, "The charge rises by 22%, and the higher charge covers every unit of that day,", "truncated"), (Q, 'ANSWER: 12 SOURCE: clause 3 QUOTE: "GBP 12.50 ... per', "truncated"), (Q, "It is charged at GBP 12.50 per", "truncated"),
    (None, "GBP 12.50", None), (None, None, "empty"),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, q, a, "x", 1) for i, (q, a, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id long, q string, a string, defect string, pair_id int")
    return {r.pair_id: r.defect for r in defective_pairs(df, "id", "q", "a", F.lit(False)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(judged, i):
    assert judged.get(i) == CASES[i][2]


def test_the_corpus_tells_what_goes_on(spark):
    full = "It depends on the date: until {0} the charge was GBP {0}, afterwards it became GBP {0}, both per visit"
    rows = [(i, Q, full.format(i)) for i in range(60)] + [(100, Q, "It depends on the date: until 7 the charge"), (101, Q, "It depends on the da"), (102, Q, "7"), (103, Q, "7"), (104, Q, "A thing said once")]
    got = {r.pair_id: r.defect for r in defective_pairs(spark.createDataFrame(rows, "id long, q string, a string"), "id", "q", "a", F.lit(None).cast("boolean")).collect()}
    assert got == {100: "truncated", 101: "truncated"}


def test_declining_may_be_right_and_repeats_are_judged_each(spark):
    rows = [(1, Q, "I cannot provide that information.", True), (2, Q, "I cannot provide that information.", False), (2, Q, "I cannot provide that information.", False), (3, Q, "word " * 100_000, False)]
    df = spark.createDataFrame(rows, "id long, q string, a string, ok boolean")
    assert sorted((r.pair_id, r.defect) for r in defective_pairs(df, "id", "q", "a", F.col("ok")).collect()) == [(2, "refusal"), (2, "refusal")]
    assert defective_pairs(df.limit(0), "id", "q", "a", F.col("ok")).count() == 0


def test_alignment():
    assert common_length("a b c d".split(), "b x d".split()) == 2 and common_length([], ["a"]) == 0
    assert shingles("a b c d".split()) == {("a", "b", "c"), ("b", "c", "d")} and shingles(["a"]) == {("a",)} and shingles([]) == set()


def found(spark, rows):
    df = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(rows)], "id long, q string, a string")
    return {(rows[r.pair_id], r.defect) for r in defective_pairs(df, "id", "q", "a", F.lit(False)).collect()}


def test_copies_do_not_outweigh_other_answers(spark):
    full = [(f"{Q} ({i})", f"It depends on the date: until {i} the charge was GBP {i}, afterwards it became GBP {i}") for i in range(20)]
    cut = (Q, "It depends on the date: until 7 the charge")
    assert found(spark, [*full, cut]) == found(spark, [*full, *[cut] * 10]) == found(spark, [*full, *[(q, f" {a.replace(' ', '  ')}\n") for q, a in full[:1]] * 30, cut]) == {(cut, "truncated")}


def test_a_hot_answer_does_not_cut_short_ones_that_are_right(spark):
    rows = [(f"{Q} ({i})", str(i)) for i in range(3)] + [(Q, "46 units in all of a day")]
    assert found(spark, rows) == found(spark, [*rows, *rows[-1:] * 60]) == set()


#: Two answers each in languages that the tables of the project don't have, and in those they have, in other words.
ANSWERS = {
    "pl": ["Tak, dziennie można rozliczyć najwyżej dwanaście jednostek.", "Cena wynosi 45 funtów za godzinę."], "sv": ["Nej, det finns ingen gräns för den här tjänsten.", "Priset är 45 pund per timme och gäller hela året."],
    "da": ["Nej, der er ingen grænse for denne ydelse.", "Prisen er 45 pund pr. time hele året."], "no": ["Prisen er 45 pund per time og gjelder hele året.", "Det finnes ingen grense for denne tjenesten."],
    "fi": ["Ei, tälle palvelulle ei ole ylärajaa.", "Hinta on 45 puntaa tunnilta."], "cs": ["Ne, pro tuto službu není stanoven žádný limit.", "Cena je 45 liber za hodinu."], "sk": ["Cena je 45 libier za hodinu.", "Pre túto službu neplatí žiadny limit."],
    "hu": ["Az ár óránként 45 font.", "Erre a szolgáltatásra nincs napi korlát."], "ro": ["Nu, nu există nicio limită pentru acest serviciu.", "Prețul este de 45 de lire pe oră."], "tr": ["Hayır, bu hizmet için günlük bir sınır yoktur.", "Fiyat saat başına 45 sterlindir."],
    "id": ["Tidak, tidak ada batas harian untuk layanan ini.", "Harga untuk layanan ini adalah 45 pound."], "hr": ["Cijena je 45 funti po satu.", "Za ovu uslugu nema dnevnog ograničenja."], "vi": ["Giá là 45 bảng mỗi giờ.", "Dịch vụ này không có giới hạn."],
    "et": ["Hind on 45 naela tunnis.", "Sellel teenusel ei ole piirangut."], "ca": ["El preu és de 45 lliures per hora.", "Aquest servei no té cap límit diari."], "pt": ["O preço é de 45 libras por hora.", "Este serviço não tem limite diário."], "nl": ["De prijs bedraagt 45 pond per uur.", "Voor deze dienst geldt geen limiet."],
    "ru": ["Цена составляет 45 фунтов в час.", "Для этой услуги нет ограничений."], "el": ["Η τιμή είναι 45 λίρες την ώρα.", "Δεν υπάρχει όριο."], "ko": ["시간당 45파운드입니다.", "한도가 없습니다."], "zh": ["价格为每小时45英镑。", "没有上限。"], "ar": ["السعر 45 جنيها في الساعة.", "لا يوجد حد."], "hi": ["कीमत 45 पाउंड प्रति घंटा है।", "कोई सीमा नहीं है।"],
    "de": ["Der Preis liegt bei 45 Pfund pro Stunde.", "Für diese Leistung gilt keine Grenze."], "fr": ["Le prix est de 45 livres par heure.", "Il n'y a pas de plafond pour ce service."], "es": ["El precio es de 45 libras por hora.", "Este servicio no tiene tope diario."], "it": ["La tariffa è di 45 sterline all'ora.", "Questo servizio non ha un limite al giorno."],
}
ENGLISH = ["The total comes to 45 pounds, premium included.", "Clause 7 sets the tariff; no cap applies.", "A patient may be billed for 12 units per visit.", "Regular rate, minus the volume discount.", "Per diem, maximum three sessions.", "Nil.", "Radiology imaging: 3 sessions; physiotherapy: 2.", "Yes, invoice INV-H1-0003 exceeds the limit.", "The annual maximum is ten, subject to prior approval.", "Not applicable", "GBP 11,551.10", "46 units", "Total: 12 x 45 = 540 cents", "No premium."]
PROMPTS = [Q, "Is there a daily limit on Rapid Spinal Gait Study?", "Rate and basis of Rapid Spinal Gait Study?"]


def is_other(model, q, a):
    return other_language(q, tokens_of(q), {"rapid", "spinal", "gait", "study"}, a, tokens_of(a), model)


def test_languages_that_the_tables_lack(spark):
    model = model_of(stop_words(spark))
    assert not {"pl", "sv", "da", "fi", "cs", "hu", "ro", "tr", "id", "hr", "vi", "et", "ca", "no", "sk"} - set(SAMPLES)
    told = {k: [is_other(model, q, a) for a in texts for q in PROMPTS] for k, texts in ANSWERS.items()}
    foreign = [k for k in told if k not in ("de", "fr", "es", "it", "ja")]
    assert len(foreign) >= 15 and sum(sum(told[k]) for k in foreign) >= 0.9 * sum(len(told[k]) for k in foreign)
    assert sum(map(sum, told.values())) >= 0.9 * sum(map(len, told.values()))
    assert not any(is_other(model, q, a) for a in ENGLISH for q in PROMPTS)
    assert not is_other(model, "Gibt es eine Obergrenze?", "Nein, für diese Leistung gilt keine Grenze.") and is_other(model, "Gibt es eine Obergrenze dafür?", "No, there is no limit on it.")


#: Refusals in words that the tables of the project don't have.
REFUSED = [
    "My guidelines prevent me from discussing rates.", "I have to respectfully pass on this one.", "I'm afraid I can't share those figures.", "We are not at liberty to disclose pricing.", "As an AI, I am not able to comment on contract terms.", "That is not something I'm able to help with.",
    "It would be inappropriate for me to answer.", "I do not have access to that data.", "This is outside of what I may discuss.", "I must decline.", "No comment.", "Cannot comment on that.", "Discussing charges is not something I can do.", "I prefer not to say.", "That would be against my policy.",
    "My help is limited to opening hours.", "Sorry, that information is confidential.", "We refuse to respond.", "I will not reveal this.", "I don't feel comfortable sharing this.", "Das kann ich leider nicht beantworten.", "Je ne peux pas répondre à cette question.", "No puedo responder a esa pregunta.",
]
ANSWERED = [
    "I cannot find a cap for it in the summary, so the answer is no: any quantity may be billed.", "Sorry to be brief: no limit applies.", "No, not in this agreement.", "I can't give a total without a day, but one unit costs GBP 12.50.", "Yes, although I cannot comment on the reason.", "The summary does not state a cap.", "Nothing is said about it, so no premium applies.",
    "Our agreement does not state a discount for it.", "The limit may not be exceeded.", "Units beyond 12 are not paid.", "No reduction is given.", "It is not permitted to bill more than 12 units.", "The provider cannot bill it twice.",
]


def test_refusals_in_other_words():
    p = tokens_of(Q)
    assert sum(is_refusal(a, p) for a in REFUSED) >= 0.9 * len(REFUSED)
    polite = " ".join(["Thank you for your patience, and please do not hesitate to turn to the billing office, which keeps the schedule and will look into the matter"] * 4)
    assert is_refusal(f"I'm sorry. I can't help with that. {polite}.", p) and is_refusal(f"{polite}. I can't help with that.", p)
    assert not any(is_refusal(a, p) for a in ANSWERED) and not declines("")
