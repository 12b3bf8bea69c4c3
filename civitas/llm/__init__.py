"""Training-data operators: language id, page text, archives, decontamination,
near and exact dedup, personal data, chat formatting, scoring, tokenising.

Nothing else in the library imports this subpackage."""
