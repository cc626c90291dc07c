"""Residue and prose that no training text holds: wording of its own, in the languages of the corpus and others."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from marlspike.llm import residue

SF = "/root/testdata/sf0.01"

#: Written apart from the rule's sentences: no sentence of theirs stands in one of these, nor the other way round.
RESIDUE = [
    "We couldn’t load this listing right now.",
    "Oh no! The page has vanished.",
    "The link you followed may be broken, or the page may have been taken down.",
    "Your connection was interrupted while we fetched this record. Retry.",
    "This video can’t be played in your region.",
    "Service outage: our engineers are looking into the failure.",
    "You don’t have access rights for that folder. Ask its owner.",
    "Our records show that you were away too long. Sign in once more.",
    "Unhandled exception in worker thread: connection reset by peer",
    "SQL error: table not found in query",
    "Gateway error. The upstream server sent an invalid response.",
    "Requests from this address are blocked because of suspicious traffic.",
    "The resource is gone and will not come back.",
    "Too many attempts from your network. Wait a few minutes and try again.",
    "We’re sorry, this file isn’t available any longer.",
    "Browser not supported. Update it or switch scripts on.",
    "JavaScript seems to be disabled. Please switch it on and reload the page.",
    "To use this website, allow JavaScript and cookies.",
    "Let’s confirm you are human. Complete the security check.",
    "Hang on while your browser is verified…",
    "This viewer needs JavaScript. Turn it on in the settings.",
    "Tick the box to show that you are not a bot.",
    "Nulla facilisi. Dolorem ipsum voluptas sit, qui blanditiis velit esse molestiae laboriosam.",
    "Quisquam voluptatem quia dolor sit, et harum quidem rerum dolores consequatur.",
    "Paste the article text here.",
    "Here goes a description that will be added later.",
    "Dummy paragraph for testing the layout.",
    "Content will be available soon.",
    "Replace these words with your own text.",
    "Die gewünschte Datei wurde nicht gefunden.",
    "Es ist ein unerwarteter Fehler beim Laden der Seite aufgetreten.",
    "Bitte schalten Sie JavaScript in Ihrem Browser ein.",
    "Platzhalter: Hier wird bald ein Inhalt stehen.",
    "Désolé, ce document n’existe plus sur notre serveur.",
    "Une erreur inconnue est survenue. Veuillez réessayer.",
    "Vous devez activer les scripts pour afficher cette page.",
    "El archivo solicitado no se encuentra en el servidor.",
    "Ha ocurrido un error inesperado. Inténtelo de nuevo más tarde.",
    "Para ver esta página active JavaScript en su navegador.",
    "Запрошенный документ не найден на сервере.",
    "При загрузке возникла неизвестная ошибка. Попробуйте ещё раз позже.",
    "Для просмотра этой страницы включите скрипты в браузере.",
    "抱歉，您请求的页面无法访问。",
    "服务器繁忙，请稍后重试。",
    "请在浏览器中打开脚本后刷新页面。",
    "指定されたページは見つかりませんでした。",
    "Erro: não foi possível encontrar o endereço pedido.",
]
PROSE = [
    "The town council voted on Tuesday to repair the old bridge before winter. Work starts in May.",
    "A new ferry line links the two islands. Tickets cost four euros, and children travel for free.",
    "Researchers measured the salt content of the lake at twelve points and compared it with the figures of last year.",
    "The library opens at nine. On Saturdays it closes at noon, and in August it stays shut.",
    "She studied in Lyon, worked as a nurse for ten years and now runs a small bakery.",
    "Rainfall in March was twice the average. Farmers expect a late harvest.",
    "The harbour office published its budget: most of the money goes to dredging and to new cranes.",
    "Our test compares five bicycle lamps. The cheapest one shone longest.",
    "An error in the ledger of 1871 led historians to the wrong date for years, the archive writes.",
    "Many sites ask visitors to accept cookies; the law requires it since 2018, a lawyer explains in the interview.",
    "Der Gemeinderat hat die neue Gebührenordnung beschlossen. Sie gilt ab dem ersten Januar.",
    "Im Frühjahr wird der Damm erhöht; die Arbeiten dauern zwei Jahre.",
    "Le musée présente une exposition sur les phares. Elle est ouverte jusqu’en septembre.",
    "Les pêcheurs demandent une aide après la tempête qui a détruit trois bateaux.",
    "El ayuntamiento aprobó el plan del puerto. Las obras empiezan en otoño.",
    "Los vecinos piden más autobuses por la noche y un carril para bicicletas.",
    "Музей открывает выставку о маяках. Она продлится до сентября.",
    "Рыбаки просят помощи после шторма, который повредил три лодки.",
    "市议会批准了港口改造方案，工程将于秋季开工。",
    "研究人员在湖中十二个地点测量了盐度，并与去年的数据进行比较。",
]
SLOT_CASES = ["Hi {{ first_name }}, thanks for writing to us.", "Posted by [[user]] on %(date)s", "Total: ${order.total}", "Sehr geehrter Herr {{nachname}}, vielen Dank.", "Autor: null", "%%TITLE%%"]
SLOT_PROSE = ["In a template the tag {{ first_name }} is replaced by the name of the customer.", "Use {0} for the first argument, the manual says, and {1} for the second.", "Null results were rare in this trial.", "None of the boats was lost.", "The field [NAME] has to be filled in by the applicant."]


@pytest.fixture(scope="module")
def ratios(spark):
    return residue.train(spark.read.parquet(f"{SF}/robust_result.parquet"), "content")


def _found(spark, ratios, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, content string")
    return {r.rec_id for r in residue.judged(rows, "id", "content", ratios).collect()}


def _plain(text: str) -> str:
    return re.sub(r"\d+", "0", " ".join(re.sub(r"[^\w\s]", " ", text.lower()).split()))


def _training() -> list[str]:
    return [p for group in (residue.CICERO, residue.FILLER, residue.ERRORS, residue.NOTICES, residue.ABOUT, residue.EXPLAINED) for p in map(_plain, group) if len(p.split()) > 2 or (len(p) > 5 and not p.isascii())]


def test_nothing_is_shared_with_the_training_text():
    status = {_plain(s.phrase) for s in residue.HTTPStatus}
    training = _training()
    for text in RESIDUE + PROSE:
        for sentence in map(_plain, re.split(r"(?<=[.!?。])\s*", text)):
            assert not sentence or not any(sentence in p and len(sentence.split()) > 2 for p in training), sentence
            assert not any(f" {p} " in f" {sentence} " and not any(x in p for x in status) for p in training), sentence


def test_no_training_phrase_stands_in_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/robust_result.parquet").select("content").distinct().collect()
    whole = " \n ".join(_plain(r.content or "") for r in pages)
    status = {_plain(s.phrase) for s in residue.HTTPStatus}
    assert [p for p in _training() if f" {p} " in whole and not any(p.endswith(x) for x in status)] == []


def test_recall_and_precision_on_held_out_texts(spark, ratios):
    found = _found(spark, ratios, RESIDUE + PROSE)
    recall = len([i for i in found if i < len(RESIDUE)]) / len(RESIDUE)
    wrong = [PROSE[i - len(RESIDUE)] for i in found if i >= len(RESIDUE)]
    print("recall", recall, "missed", [t for i, t in enumerate(RESIDUE) if i not in found], "wrong", wrong)
    assert recall >= 0.9 and len(wrong) <= 1


def test_placeholders_held_out(spark, ratios):
    found = _found(spark, ratios, SLOT_CASES + SLOT_PROSE)
    assert found == set(range(len(SLOT_CASES))), [(SLOT_CASES + SLOT_PROSE)[i] for i in found ^ set(range(len(SLOT_CASES)))]
