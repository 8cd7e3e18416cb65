"""Reading ledgers: file checks, delimited text, spreadsheets, nested documents, column mapping and typing."""
