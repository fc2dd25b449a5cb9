"""Where documents come from: tables need nothing of their own; `filesystem` reads a folder tree."""
