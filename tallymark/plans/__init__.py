"""The registered queries over the test tables, their inputs and the SQL that checks them."""
