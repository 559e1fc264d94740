import pytest
from pyspark.sql import functions as F

from parley.functions import guards, text
from parley.functions.similarity import intent_similarity


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("I can't go", "I cannot go"), ("CAN'T", "CANNOT"), ("Can’t", "Cannot"), ("couldn't've", "could not have"), ("'Bout time", "About time"),
        ("Apple's policy", "Apple's policy"), ("see https://x.com/don't now", "see https://x.com/don't now"), ("Spirit's", "Spirit's"), ("y'all gonna", "you all going to"), ("", ""), ("   ", "   "),
    ],
)
def test_contractions(given, want):
    assert text.expand_contractions(given) == want
    assert text.expand_contractions(want) == want


def test_contractions_null_udf(one):
    assert one(text.expand_udf, None) is None
    assert one(text.expand_udf, "I'm") == "I am"


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("go to https://a.com/x.", "go to <url>."), ("www.foo.org now", "<url> now"), ("support.apple.com/iphone-x ok", "<url> ok"), ("t.co/abc123", "<url>"),
        ("iPhone X at https://a.com/iPhone", "iPhone X at <url>"), ("__email__ and SM-T280", "__email__ and SM-T280"), ("plain.", "plain."),
    ],
)
def test_urls_and_entities(one, given, want):
    assert text.mask_urls(given) == want
    assert text.preserve_entities(given) == want
    assert one(text.mask_urls_col, given) == want


def test_preserve_hides_entities_from_the_change():
    assert text.preserve_entities("My iOS 11.1 5 times", str.upper) == "MY iOS 11.1 5 TIMES"


def test_tokenizer():
    assert text.tokenize("My SM-T280, (iOS 11.1) is slow") == ["my", "sm-t280", "ios 11.1", "is", "slow"]
    assert text.tokenize("iPhone  11 Pro Max") == ["iphone 11 pro max"]
    assert text.tokenize(None) == []
    assert text.tokenize("café 2") == ["caf", "2"]


def test_plain_tokens_agree_without_entities(one):
    t = "The one, the TWO: 3x! café"
    assert one(text.plain_tokens, t) == text.tokenize(t)
    assert one(text.plain_tokens, None) == []


def test_sanitize_words_tokens(one):
    assert one(text.sanitize, "a\x00b") == "ab"
    assert one(text.sanitize, None) == ""
    assert one(text.word_count, "  a b c \n d ") == 4
    assert one(text.word_count, None) == 0
    assert one(text.estimate_tokens, "a b c") == 4


def test_claims(one):
    assert one(text.extract_claims, "Hello there friend. The battery lasts ten hours. Ok.\n- It was fixed in May") == ["The battery lasts ten hours.".rstrip("."), "It was fixed in May"]
    assert one(text.extract_claims, None) == []


def test_trivial_reply(one):
    assert one(text.trivial_reply, "I need HELP") is not None
    assert one(text.trivial_reply, "very helpful") is None


@pytest.mark.parametrize(
    ("given", "want", "kinds"),
    [
        ("card 4111 1111 1111 1111 ok", "card [REDACTED_CREDIT_CARD] ok", ["credit_card"]), ("card 4111 1111 1111 1112", "card 4111 1111 1111 1112", []),
        ("SSN: 123-45-6789.", "SSN: [REDACTED_SSN].", ["ssn"]), ("123-45-6789 and 4111111111111111", "[REDACTED_SSN] and [REDACTED_CREDIT_CARD]", ["ssn", "credit_card"]),
        ("Tax ID 123456789", "Tax ID [REDACTED_SSN]", ["ssn"]), ("1234567890", "1234567890", []), ("", "", []), (None, "", []),
    ],
)
def test_pii(one, given, want, kinds):
    got = one(guards.mask_pii, given)
    assert (got["text"], got["types"]) == (want, kinds)


def test_luhn():
    assert guards.luhn("4111-1111-1111-1111")
    assert not guards.luhn("4111-1111-1111-1112")
    assert not guards.luhn("0") and not guards.luhn("")


def test_toxicity(one):
    assert one(guards.toxicity, "you are an idiot") == pytest.approx(1.0)
    assert one(guards.toxicity, "What a waste of time") == pytest.approx(0.66)
    assert one(guards.toxicity, "fine thanks") == 0.0
    assert one(guards.toxicity, None) == 0.0
    assert one(guards.is_toxic, "lazy")


@pytest.mark.parametrize(
    ("given", "want"),
    [("Samsung is better", "Samsung"), ("It works with Samsung phones", None), ("I saw a Samsung", None), ("I saw a Samsung. Avoid that.", "Samsung"), ("Up front we recommend this", "Front"), ("", None), (None, None)],
)
def test_competitors(one, given, want):
    assert guards.competitor_mention(given) == want
    assert one(guards.competitor_udf, given) == want


def test_ids(one):
    assert one(guards.valid_id, " TCKT-123456 ") and not one(guards.valid_id, "TCKT-12") and not one(guards.valid_id, None)
    assert one(guards.valid_ticket_tags, ["id:TCKT-123456", "x"], kinds=["array<string>"])
    assert not one(guards.valid_ticket_tags, ["tckt-12"], kinds=["array<string>"])
    assert one(guards.valid_ticket_tags, [], kinds=["array<string>"])


def test_rails(one):
    assert one(guards.input_rail, "Who wins the election?")["reason"] == "political discourse"
    assert one(guards.input_rail, "iPhone or a Samsung?")["reason"].startswith("competitor")
    assert one(guards.input_rail, "  ")["passed"] and one(guards.input_rail, None)["passed"]
    assert one(guards.output_rail, "It has a lifetime warranty.")["action"] == "redirect_warranty"


def test_dialog_rejection_changes_nothing(one):
    got = one(guards.dialog_rail, ["my battery dies", "can I buy one", "ok", "my screen broke", "refund please"], kinds=["array<string>"])
    assert [(x["passed"], x["turns"]) for x in got] == [(True, 1), (False, 1), (True, 2), (True, 3), (True, 4)]
    assert got[-1]["topic"] == "screen repair"
    assert one(guards.dialog_rail, [], kinds=["array<string>"]) == []


def test_intent_similarity():
    assert intent_similarity("billing", "Billing ") == 1.0
    assert intent_similarity("", "x") == 0.0
    assert intent_similarity("billing_inquiry", "billing_issue") > 0.6
    assert intent_similarity("refund order", "order refund") == 1.0


def test_mask_url_column_uses_no_python(spark):
    df = spark.createDataFrame([("a",)], "t string").select(text.mask_urls_col(F.col("t")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
