import pytest

from tidemark.operators.extraction import extract_offers, offer_candidates


def ld(body):
    return f'<html><script type="application/ld+json">{body}</script></html>'


def offer(inner, kind="Offer"):
    return f'{{"@type":"{kind}",{inner}}}'


PRICED = '"price":"129.99","priceCurrency":"USD","availability":"https://schema.org/InStock"'
MICRO = (
    '<section itemscope itemtype="https://schema.org/Product"><div itemprop="offers" itemscope '
    'itemtype="https://schema.org/{kind}">{inner}</div></section>'
)


def micro(inner, kind="Offer"):
    return MICRO.format(kind=kind, inner=inner)


USD = '<meta itemprop="priceCurrency" content="USD">'
OK = (True, None, 12999, "USD")

CASES = {
    "one clean offer": (ld(offer(PRICED)), (*OK, "https://schema.org/InStock")),
    "yen": (ld(offer('"price":"12800","priceCurrency":"JPY"')), (True, None, 12800, "JPY", "")),
    "three places": (ld(offer('"price":12.995,"priceCurrency":"KWD"')), (True, None, 12995, "KWD", "")),
    "unknown availability is kept as it is": (ld(offer('"price":129.99,"priceCurrency":"USD","availability":" SoonIsh "')), (*OK, "SoonIsh")),
    "script attributes in any order and case": ('<SCRIPT data-x="1" TYPE = \'application/ld+json\' id="a">' + offer(PRICED) + "</SCRIPT>", (*OK, "https://schema.org/InStock")),
    "same offer twice is one": (ld(offer(PRICED)) + ld('{"@graph":[' + offer(PRICED) + "]}"), (*OK, "https://schema.org/InStock")),
    "nested offers are two": (ld(offer(PRICED + ',"offers":' + offer('"price":"1","priceCurrency":"USD"'))), "ambiguous-offer"),
    "two offers": (ld("[" + offer(PRICED) + "," + offer('"price":"99","priceCurrency":"USD"') + "]"), "ambiguous-offer"),
    "range": (ld(offer('"lowPrice":"4.28","highPrice":"7.65","priceCurrency":"USD"', "AggregateOffer")), "ambiguous-offer"),
    "range whose ends agree": (ld(offer('"lowPrice":"129.99","highPrice":"129.99","priceCurrency":"USD"', "AggregateOffer")), (*OK, "")),
    "half a range": (ld(offer('"lowPrice":"4.28","priceCurrency":"USD"', "AggregateOffer")), "ambiguous-offer"),
    "price beats range": (ld(offer('"price":129.99,"lowPrice":"1","highPrice":"2","priceCurrency":"USD"')), (*OK, "")),
    "no price": (ld(offer('"priceCurrency":"USD"')), "no-price"),
    "text price": (ld(offer('"price":"Call for price","priceCurrency":"USD"')), "no-price"),
    "negative price": (ld(offer('"price":"-129.99","priceCurrency":"USD"')), "no-price"),
    "price too fine": (ld(offer('"price":"129.995","priceCurrency":"USD"')), "no-price"),
    "exponent number": (ld(offer('"price":1e25,"priceCurrency":"USD"')), "no-price"),
    "exponent that is plain": (ld(offer('"price":1.2999e2,"priceCurrency":"USD"')), (*OK, "")),
    "no currency": (ld(offer('"price":"129.99"')), "no-currency"),
    "currency symbol": (ld(offer('"price":"129.99","priceCurrency":"$"')), "no-currency"),
    "no currency is asked before the price": (ld(offer('"price":"soon","priceCurrency":"$"')), "no-currency"),
    "value and id objects": (ld(offer('"price":{"@value":129.99},"priceCurrency":{"@value":"usd"},"availability":{"@id":" InStock "}')), (*OK, "InStock")),
    "type list and long type names": (ld('{"@type":["Thing","http://schema.org/OFFER"],' + PRICED + "}"), (*OK, "https://schema.org/InStock")),
    "other types are no offers": (ld('{"@type":"SpecialOffer",' + PRICED + "}"), "no-offer"),
    "context is not walked": (ld('{"@context":' + offer(PRICED) + "}"), "no-offer"),
    "malformed block is skipped": (ld("{broken") + ld(offer(PRICED)), (*OK, "https://schema.org/InStock")),
    "a block with something after its value is malformed": (ld(offer(PRICED) + "]"), "no-offer"),
    "only a malformed block": (ld("{broken"), "no-offer"),
    "last of a repeated key": (ld('{"@type":"Offer","price":"1","price":"129.99","priceCurrency":"USD"}'), (*OK, "")),
    "deeper than the walk": (ld('{"a":' * 40 + offer(PRICED) + "}" * 40), (*OK, "https://schema.org/InStock")),
    "shallow and deep disagree": (ld('[{"@type":"Offer","price":"1","priceCurrency":"USD"},' + '{"a":' * 40 + offer(PRICED) + "}" * 40 + "]"), "ambiguous-offer"),
    "no markup at all": ("<html><p>129.99</p></html>", "no-offer"),
    "empty page": ("", "no-offer"),
    "microdata": (micro(USD + '<span itemprop="price">$129.99</span><link itemprop="availability" href="https://schema.org/InStock">'), (*OK, "https://schema.org/InStock")),
    "microdata states one price twice": (micro(USD + '<meta itemprop="price" content="129.99"><b itemprop="price">$129.99</b>'), (*OK, "")),
    "microdata states two prices": (micro(USD + '<s itemprop="price">149.99</s><b itemprop="price">129.99</b>'), "ambiguous-offer"),
    "microdata with two currencies": (micro(USD + '<i itemprop="priceCurrency">CAD</i><b itemprop="price">129.99</b>'), "ambiguous-offer"),
    "microdata range": (micro(USD + '<b itemprop="lowPrice">1</b><b itemprop="highPrice">2</b>', "AggregateOffer"), "ambiguous-offer"),
    "two microdata offers": (micro(USD + '<b itemprop="price">1</b>') + micro(USD + '<b itemprop="price">2</b>'), "ambiguous-offer"),
    "price outside the offer": ('<b itemprop="price">5</b>' + micro(USD + '<b itemprop="price">129.99</b>') + '<b itemprop="price">6</b>', (*OK, "")),
    "nested item keeps its own price": (micro(USD + '<b itemprop="price">129.99</b><div itemscope itemtype="https://schema.org/UnitPrice"><div><b itemprop="price">1</b></div></div>'), (*OK, "")),
    "same name nested closes in order": (micro(USD + '<div><div></div></div><b itemprop="price">129.99</b>') + '<div itemprop="price">7</div>', (*OK, "")),
    "self-closing offer has no extent": ('<div itemscope itemtype="https://schema.org/Offer"/><b itemprop="price">1</b>', "no-price"),
    "several names in one itemprop": (micro(USD + '<b itemprop="price lowPrice">129.99</b>'), (*OK, "")),
    "markup in scripts and comments is text": ('<!-- ' + micro(USD + '<b itemprop="price">5</b>') + ' --><script>var a = "<div itemscope itemtype=\'https://schema.org/Offer\'>";</script>' + micro(USD + '<b itemprop="price">129.99</b>'), (*OK, "")),
    "greater-than inside a quoted value": (micro(USD + '<b title="a > b" itemprop="price">129.99</b>'), (*OK, "")),
    "a longer attribute name is another attribute": (micro(USD + '<b data-content="5" itemprop="price">129.99</b>'), (*OK, "")),
    "a price split over a child element": (micro(USD + '<b itemprop="price">129<sup>99</sup></b>'), "no-price"),
    "microdata without currency": (micro('<b itemprop="price">129.99</b>'), "no-currency"),
    "json-ld wins over microdata": (ld(offer(PRICED)) + micro(USD + '<b itemprop="price">5</b>'), (*OK, "https://schema.org/InStock")),
    "other vocabularies are no offers": ('<div itemscope itemtype="https://example.org/Offer"><b itemprop="price">5</b></div>', "no-offer"),
    "unclosed offer reads on": ('<div itemscope itemtype="https://schema.org/Offer">' + USD + '<b itemprop="price">129.99</b>', (*OK, "")),
    "unclosed tag ends the page": (micro(USD + '<b itemprop="price">129.99</b>') + '<div itemtype="https://schema.org/Offer', (*OK, "")),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    pages = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(CASES.values())], "page_id long, html string")
    rows = {r.page_id: r for r in extract_offers(pages).collect()}
    return {name: rows[i] for i, name in enumerate(CASES)}


@pytest.mark.parametrize("name", CASES)
def test_verdict(verdicts, name):
    want = CASES[name][1]
    got = verdicts[name]
    if isinstance(want, str):
        assert (got.ok, got.reason, got.amount_minor_units, got.currency, got.availability) == (False, want, None, None, None)
    else:
        assert (got.ok, got.reason, got.amount_minor_units, got.currency, got.availability) == want


def test_no_page_text_is_shuffled(spark):
    pages = spark.range(3).selectExpr("id AS page_id", "'<p>' AS html")
    plan = offer_candidates(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
