import pytest
from pyspark.sql import functions as F

from folio.operators import guards as G


@pytest.mark.parametrize(("question", "category"), [
    ("What is the home address of the director?", "home_address"), ("Where does the CEO live?", "home_address"), ("promoter ka ghar ka pata", "home_address"), ("निदेशक के घर का पता क्या है?", "home_address"), ("What is the promoter's phone number?", "personal_contact"),
    ("Email of the founder please", "personal_contact"), ("सीईओ का मोबाइल", "personal_contact"), ("director's pan", "identity_number"), ("प्रमोटर का आधार", "identity_number"), ("Aadhaar for him", "identity_number"),
    ("What is the registered office and phone of the company secretary?", None), ("Who is the compliance officer, and their email?", None), ("How much is the fresh issue?", None), ("", None), (None, None),
])
def test_questions(spark, question, category):
    r = spark.createDataFrame([(question,)], "q string").select(G.private_question(F.col("q")).alias("r")).first()["r"]
    assert (r and r["category"]) == category and (r is None or r["matched"] in question.lower())


@pytest.mark.parametrize(("answer", "question", "category"), [
    ("The CEO lives at 12 Park Street.", "", "personal_address"), ("Flat no. 12, Green Apartments", "", "address_detail"), ("वह सेक्टर 21 में हैं", "", "address_detail"), ("PAN is ABCDE1234F", "", "identity_number"), ("Call 9876543210", "", "phone_or_email"), ("a.b@c.co", "", "phone_or_email"),
    ("Call the registrar at 9876543210", "", None), ("Call 9876543210", "registered office?", None), ("The registrar has 1234 5678 9012", "", "identity_number"), ("Revenue was ₹ 5 crore.", "", None), (None, "", None),
])
def test_answers(spark, answer, question, category):
    r = spark.createDataFrame([(answer, question)], "a string, q string").select(G.private_answer(F.col("a"), F.col("q")).alias("r")).first()["r"]
    assert (r and r["category"]) == category and (r is None or r["matched"] in answer)


def test_spellings_are_one(spark):
    r = spark.createDataFrame([("  Ye FLAG’s ज़ँ ज़ ",)], "q string").select(G.normal_question(F.col("q")).alias("r")).first()["r"]
    assert r == "ye flag's जं ज"
