from gaugeflow.llm.text import own_paragraphs


def test_a_rule_does_not_end_the_post():
    assert own_paragraphs("One two.\n\n-----\n\nThree four.\n\n-- \nname\nmotto") == ["One two.", "Three four."]
    assert own_paragraphs("One.\n-- \nname\nmotto\n\n> quoted\n\nTwo.") == ["One.", "Two."]
