"""Brute-force tokenizers for comparison."""

from tokenmill.functions.bytelevel import byte_symbols

SYMBOLS = byte_symbols()


def to_symbols(data: bytes) -> str:
    return "".join(SYMBOLS[b] for b in data)


def spaced_words(text: str):
    """(word, space directly before it) for every word."""
    words, word, space, before = [], "", False, ""
    for c in text:
        if c in " \n\t":
            if word:
                words.append((word, space))
                word = ""
        else:
            if not word:
                space = before == " "
            word += c
        before = c
    if word:
        words.append((word, space))
    return words


def longest_matches(form, vocab, max_match=None):
    ids, at = [], 0
    while at < len(form):
        for end in range(len(form), at, -1):
            piece = form[at:end]
            if max_match is not None and len(piece.encode()) > max_match:
                continue
            if piece in vocab:
                ids.append(vocab[piece])
                at = end
                break
        else:
            at += 1
    return ids


def greedy(text, vocab, max_word=None, max_match=None):
    out = []
    for word, space in spaced_words(text):
        form = to_symbols(word.encode()[:max_word])
        prefix = "Ġ" if space and out else ""
        if prefix + form in vocab:
            out.append(vocab[prefix + form])
            continue
        if prefix and "Ġ" in vocab:
            out.append(vocab["Ġ"])
        out += longest_matches(form, vocab, max_match)
    return out
