from lexshard.cli import main

main()
