"""The operators of quern.operators, evaluated by numpy over blocks of whole units."""
