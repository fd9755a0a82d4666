ODD = [None, "", " \n\t ", "one", "Two words", "x" * 200_000, "same text here for all of it", "same text here for all of it", "!!! ??? ...", "é ü 你好 \U0001f600 ", "line\n\nline\r\nline"]
