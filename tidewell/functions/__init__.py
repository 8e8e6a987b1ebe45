"""Column functions on network fields; all but the text form of addresses stay inside Catalyst."""
