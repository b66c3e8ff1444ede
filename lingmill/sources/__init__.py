"""Readers and writers: model text files, skipword files, phrase files, wiki dumps."""
