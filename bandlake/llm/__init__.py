"""Corpus operators: mixing, scoring, decontamination, deduplication, licences, languages, images and chats."""
