import pytest

from quarry.functions.stems import english, spanish, stems

# Word and stem, from the published sample vocabularies.
ENGLISH = """consign consign consigned consign consistency consist consolatory consolatori consolidate consolid knackeries
knackeri knavish knavish generously generous relational relat happy happi running run hoping hope hopping hop ties tie
cries cri easily easili skies sky inning inning"""
SPANISH = """chicos chic chicharrones chicharron chihuahua chihuahu chilenos chilen torneos torne torniquete torniquet
torpedearon torped torrentes torrent torturado tortur facturas factur"""


@pytest.mark.parametrize("stemmer,pairs", [(english, ENGLISH), (spanish, SPANISH)])
def test_published_samples(stemmer, pairs):
    pairs = pairs.split()
    assert [stemmer(w) for w in pairs[::2]] == pairs[1::2]


def test_stems_of_short_words_and_numbers():
    assert stems("the") == [] and stems("2024") == [] and ("factur", "factur") in stems("facturas")
