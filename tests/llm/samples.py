#: Texts at the edges: null, empty, white space, one word, repeated, long, beyond ASCII, control characters.
EDGES = [None, "", " \n\t", "word", "word", "a b", "Ünïcode ß 日本語 🙂 x", "x\x00y \x85 \xa0z", "long " * 20000, "no-space" * 5000, "1 2 3 4 5 6 7 8 9"]
