"""All relations of a set of C units, built on demand from one another, and as temporary views for SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..blocks.frame import Frame
from ..blocks.units import LARGE, of_blocks, with_unit
from ..operators import code, declarations, inner, lexing, names, preprocessor, regions, spans, trees, typedefs
from ..sources.tables import dropped, written

ENGINE = {"name": "quern", "version": "0.1.0", "language": "C23"}


class Program:
    """Relations over units (unit_id, src). Views that only need tokens never build declarations.

    A relation that reads its tokens several times reads them from `kept` or `full`, tables written
    once in the shared folder: the source is lexed once. A unit is one share of work, and its tokens
    must fit a task's sort, which spills.

    predefined names are types from the start. ordered: a typedef of a word that is no type yet binds
    that word (see operators.typedefs); else it binds the name that it declares.
    """

    def __init__(self, units: DataFrame, predefined: list[str] = (), ordered: bool = False):
        self.units, self.predefined, self.ordered = units, list(predefined), ordered

    def by_blocks(self, relation: Callable[[Program], DataFrame], columns: str, large: int = LARGE) -> DataFrame:
        """relation(self) with unit_id and the given columns, of units apart from each other: blocks of whole units are evaluated in memory.

        `relation` calls operators, which are the same there (see blocks.facade). Units of over
        `large` characters are evaluated by Spark's windows, whose sorts spill.
        """
        schema, predefined, ordered = with_unit(self.units, columns), self.predefined, self.ordered
        names = schema.names

        def of_block(tokens: Frame) -> Frame:
            program = Program(tokens, predefined, ordered)
            program.raw_tokens = tokens
            return relation(program).select(names)

        sizes = self.units.groupBy("unit_id").agg(F.sum(F.length("src")).alias("n")).where(F.col("n") > large).select("unit_id")
        sizes = written(sizes, "large-units")
        if sizes.isEmpty():
            dropped(sizes)
            return of_blocks(self.units, of_block, schema)
        small = self.units.join(sizes.hint("shuffle_merge"), "unit_id", "left_anti")
        few = Program(self.units.join(sizes.hint("shuffle_merge"), "unit_id", "left_semi"), predefined, ordered)
        own = relation(few)
        own = own.select(*(own[f.name].cast(f.dataType).alias(f.name) for f in schema))
        return of_blocks(small, of_block, schema).union(own)

    @cached_property
    def lexemes(self) -> DataFrame:
        return lexing.lexemes(self.units)

    @cached_property
    def raw_tokens(self) -> DataFrame:
        """Tokens whose identifiers are all ID."""
        return lexing.tokens(self.units)

    @cached_property
    def kept_tokens(self) -> DataFrame:
        """raw_tokens, written."""
        return written(self.raw_tokens, "tokens")

    @cached_property
    def directives(self) -> DataFrame:
        return preprocessor.directives(self.raw_tokens)

    @cached_property
    def raw_marked(self) -> DataFrame:
        """Tokens with their declaration, for a relation that reads them once."""
        return declarations.with_declarations(self.raw_tokens)

    @cached_property
    def kept(self) -> DataFrame:
        """raw_marked without the trivia, written."""
        return written(self.raw_marked.drop("leading"), "marked")

    @cached_property
    def tokens(self) -> DataFrame:
        """Tokens whose identifiers are told apart; without the trivia before them, which raw_tokens has."""
        # From the source itself, unless `kept` is there already.
        marked = self.kept if self.ordered else self.__dict__.get("kept", self.raw_marked.drop("leading"))
        found = declarations.classified(marked, self.predefined, not self.ordered)
        if self.ordered:
            found = typedefs.with_typedefs(found, typedefs.ordered_typedefs(typedefs.typedef_parts(self.kept), self.predefined))
        return found.select([c for c in self.raw_tokens.columns if c != "leading"])

    @cached_property
    def marked(self) -> DataFrame:
        """Tokens with their declaration; identifiers told apart."""
        return declarations.with_declarations(self.tokens)

    @cached_property
    def full(self) -> DataFrame:
        """marked, written."""
        return written(self.marked, "told-apart")

    @cached_property
    def declarations(self) -> DataFrame:
        return declarations.declarations(self.raw_marked)

    @cached_property
    def conditional_branches(self) -> DataFrame:
        return preprocessor.conditional_branches(declarations.declarations(self.kept), written(preprocessor.directives(self.kept), "directives"))

    @cached_property
    def bracketed(self) -> DataFrame:
        """Tokens of code with their brackets and local declarations, written."""
        return written(trees.bracketed(self.full), "bracketed")

    @cached_property
    def regions(self) -> DataFrame:
        """Regions of the units, written."""
        return written(regions.regions(self.full, self.bracketed), "regions")

    @cached_property
    def name_uses(self) -> DataFrame:
        """Names in expressions and what they refer to, written."""
        return written(names.resolved(self.full, self.bracketed), "name-uses")

    @cached_property
    def status(self) -> DataFrame:
        return lexing.parse_status(self.units)

    def relations(self) -> dict[str, DataFrame]:
        raw, full = self.kept, self.full
        lines = written(preprocessor.directives(raw), "directives")
        return {
            "c_lexemes": self.lexemes, "c_tokens": full.select(self.tokens.columns).join(self.raw_tokens.select("unit_id", "tok_ix", "leading"), ["unit_id", "tok_ix"]), "c_status": self.status,
            "c_directives": lines, "c_defines": preprocessor.defines(lines), "c_includes": preprocessor.includes(lines),
            "c_macro_events": preprocessor.macro_events(lines), "c_conditionals": preprocessor.conditional_lines(lines), "c_branches": self.conditional_branches,
            "c_declarations": declarations.declarations(raw), "c_symbols": declarations.symbols(raw).drop("_parens", "_listed"), "c_typedefs": declarations.typedef_events(raw),
            "c_tags": declarations.tags(raw), "c_members": declarations.members(raw), "c_enumerators": declarations.enumerators(raw), "c_parameters": declarations.parameters(raw),
            "c_functions": code.functions(raw), "c_statements": code.statements(raw), "c_jumps": code.jumps(raw), "c_labels": code.labels(raw), "c_calls": inner.calls(full),
            "c_operators": code.operators(raw), "c_literals": code.literals(raw), "c_attributes": code.attributes(raw), "c_static_asserts": inner.static_asserts(raw),
            "c_initializer_items": code.initializer_items(raw), "c_generic_associations": code.generic_associations(raw), "c_generic_selections": inner.generic_selections(raw), "c_asm": code.asm_blocks(raw),
            "c_conditions": spans.conditions(raw), "c_type_names": spans.type_names(full), "c_array_sizes": spans.array_sizes(raw), "c_specifiers": spans.specifiers(full),
            "c_member_uses": spans.member_uses(raw), "c_asm_operands": spans.asm_operands(raw),
            "c_local_symbols": inner.local_symbols(self.bracketed), "c_subscripts": inner.subscripts(full), "c_commas": inner.comma_operators(full), "c_expression_statements": inner.expression_statements(full),
            "c_name_uses": self.name_uses, "c_unused_names": names.unused(full, self.name_uses, self.bracketed), "c_regions": self.regions, "c_ancestors": regions.ancestors(self.regions), "c_branch_members": regions.branch_members(raw), "c_expressions": trees.expressions(self.bracketed), "c_statement_expressions": inner.statement_expressions(raw), "c_bit_int_widths": inner.bit_int_widths(raw), "c_pointer_levels": inner.pointer_levels(raw), "c_array_qualifiers": inner.array_qualifiers(raw),
        }

    def release(self) -> None:
        """Deletes the tables that this program has written; what reads them can't be run any more."""
        for name, found in list(self.__dict__.items()):
            if isinstance(found, DataFrame) and name != "units":
                dropped(found)
                del self.__dict__[name]

    def register(self) -> None:
        """Makes every relation a temporary view of the session."""
        for name, df in self.relations().items():
            df.createOrReplaceTempView(name)


def engine_info(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(ENGINE.values())], ", ".join(f"{k} string" for k in ENGINE))
