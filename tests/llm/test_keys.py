"""Private keys in texts."""

from traceloom.llm.secrets import RULES, arrays, load, redacted


def test_the_body_of_a_private_key_goes_with_its_first_line():
    body = "\n".join("MIIEvQ+/aB9z" * 5 for _ in range(20)) + "\nQ2==\n"
    text = f"before\n-----BEGIN RSA PRIVATE KEY-----\n{body}-----END RSA PRIVATE KEY-----\nafter"
    clean = redacted(text, load(RULES, arrays(RULES)))
    assert clean == "before\n[PEM]-----END RSA PRIVATE KEY-----\nafter"
