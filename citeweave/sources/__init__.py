"""Files as tables: bytes of unknown encoding, tagged records, Word documents."""
