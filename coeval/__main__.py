from coeval.cli import main

main()
